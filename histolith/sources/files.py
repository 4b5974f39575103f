"""Files beside the bundle: annotations, gene lists, gene models, and stores of metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.operators.packed import split_packed

SEPARATORS = ("\t", ",", ";")
GTF_COLUMNS = "seqname string, source string, feature string, start_pos long, end_pos long, score string, strand string, frame string, attribute string"


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Barcode, Cluster of a delimited file; the separator is the one its header holds most often, labels keep letters and digits only."""
    first = spark.read.text(path).first()
    head = first[0] if first else ""
    sep = max(SEPARATORS, key=head.count)
    df = spark.read.csv(path, sep=sep, header=True)
    return df.select(F.col(df.columns[0]).alias("Barcode"), F.regexp_replace(F.col(df.columns[1]), "[^A-Za-z0-9]", "").alias("Cluster"))


def write_annotation(df: DataFrame, path: str, barcode: str, cluster: str) -> None:
    """Tab-separated Barcode, Cluster with a header."""
    df.select(F.col(barcode).alias("Barcode"), F.col(cluster).alias("Cluster")).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_phase_genes(spark: SparkSession, path: str) -> DataFrame:
    """phase, gene of a JSON object of gene lists by phase (S, G2M)."""
    df = spark.read.json(path, multiLine=True)
    parts = [df.select(F.lit(c).alias("phase"), F.explode(c).alias("gene")) for c in df.columns if df.schema[c].dataType.typeName() == "array"]
    if not parts:
        return spark.createDataFrame([], "phase string, gene string")
    return reduce(DataFrame.unionByName, parts)


def read_gene_models(spark: SparkSession, path: str, feature: str | None = "gene") -> DataFrame:
    """gene_id, gene_name, gene_type of a GTF text, gzipped or not; missing ones are null. Comment lines are skipped."""
    # A GTF line has nine fields; only the first eight tabs separate them.
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t", 9)
    df = lines.select(F.monotonically_increasing_id().alias("line"), F.get(parts, F.lit(2)).alias("feature"), F.get(parts, F.lit(8)).alias("attribute"))
    return gene_models(df if feature is None else df.where(F.col("feature") == feature), "line")


def gene_models(lines: DataFrame, key: str, attribute: str = "attribute") -> DataFrame:
    """key, gene_id, gene_name, gene_type of annotation lines; of repeated entries the first counts."""
    entries = split_packed(lines, attribute, [key]).where(F.col("attr_key").isin("gene_id", "gene_name", "gene_type"))
    pick = lambda n: F.min_by(F.when(F.col("attr_key") == n, F.col("attr_value")), F.when(F.col("attr_key") == n, F.col("pos"))).alias(n)
    return lines.select(key).join(entries.groupBy(key).agg(pick("gene_id"), pick("gene_name"), pick("gene_type")), key, "left")


class MetricStore:
    """A folder with one Parquet table per metric, joined on demand."""

    def __init__(self, spark: SparkSession, root: str, key: str = "cell_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.names: list[str] = []

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        if name not in self.names:
            self.names.append(name)

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df.select(self.key, *columns) if columns else df

    def join(self, base: DataFrame, names: list[str] | None = None) -> DataFrame:
        """base with the columns of the metrics that it does not have yet, null where a metric has no row."""
        for name in names or self.names:
            df = self.read(name)
            new = [c for c in df.columns if c not in base.columns]
            if new:
                base = base.join(df.select(self.key, *new), self.key, "left")
        return base


def write_regions(df: DataFrame, path: str) -> None:
    """JSON lines of island regions."""
    df.write.mode("overwrite").json(path)
