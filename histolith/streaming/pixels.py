"""Pixel counts and time windows over a stream of molecules or events; an extension of the batch engine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.session import stage_dir

STATE = "spark.sql.streaming.stateStore"
#: The state lies on the executors' disks, with a limit for all its stores of an executor; Spark's default keeps it on their heaps.
STATE_ON_DISK = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.maxMemoryUsageMB": "500",
}


def stream_pixel_counts(molecules: DataFrame) -> DataFrame:
    """Running molecule counts per pixel; write in update or complete mode."""
    return molecules.groupBy(F.col("x").cast("int").alias("px"), F.col("y").cast("int").alias("py")).agg(F.count(F.lit(1)).alias("n"))


def stream_window_counts(events: DataFrame, time: str, kind: str, *, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts per time window and kind, finished once the watermark has passed; write in append mode."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), kind, "n")


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Process everything that is available and return the result as a table.

    The executors write the batches as Parquet to the shared folder; the driver receives no rows. In complete mode a batch
    holds the whole result and takes the place of the one before, else the result is the rows of all batches.
    """
    folder = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written: dict[str, None] = {}

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/rows" if mode == "complete" else f"{folder}/rows-{number}"
        batch.write.mode("overwrite").parquet(path)  # a batch that is tried again is there once
        written[path] = None

    with state_on_disk(spark):
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*written) if written else spark.createDataFrame([], stream.schema)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk, unless the session names a provider itself; the settings end with the block."""
    ours = {} if spark.conf.get(f"{STATE}.providerClass", None) else {k: v for k, v in STATE_ON_DISK.items() if spark.conf.get(k, None) is None}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)
