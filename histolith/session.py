"""Session helpers: shared scratch folder, lineage cuts and table reading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where neither the setting nor a checkpoint folder exists (plain local tests) a
    temporary folder of this machine is made and set.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = "file://" + tempfile.mkdtemp(prefix="histolith-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage_dir(spark: SparkSession) -> str:
    """The folder of this application's stages in the shared folder."""
    return f"{scratch_dir(spark)}/histolith/{spark.sparkContext.applicationId}"


def remove_stages(spark: SparkSession) -> None:
    """Delete all stages this application has written; frames made from them cannot be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here.

    Parquet rather than ``checkpoint()``: later readers prune columns, the files hold
    compressed columns, and a lost executor costs nothing but a re-read.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Spark's Python workers import this package, once per application.

    The source files travel as a zip through the driver's file server, so executors need no
    copy of the repository.
    """
    sc = spark.sparkContext
    if getattr(sc, "_histolith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="histolith-")) / "histolith.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._histolith_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def spread(df: DataFrame) -> DataFrame:
    """Cut a frame of fewer partitions than the cluster has cores to as many, for work that outweighs a shuffle of the input.

    A large input has more partitions than cores already and is left as it is. For scans and projections of them: to learn the
    partitions of a join, Spark would run its stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
