"""The tables of a tissue bundle, with identities and missing values put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.operators.latest import clean_name, latest_rows
from histolith.session import table

#: Name that stands for a missing gene name, and id of molecules outside every cell.
NO_GENE, NO_CELL = "NaN", -1


def number(col: Column) -> Column:
    """A double, null where it is NaN."""
    return F.when(~F.isnan(col.cast("double")), col.cast("double"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """One row per transcript, the one ingested last, with pixel coordinates ``px``, ``py``.

    Columns: transcript_id, x, y, z, gene, cell_id, qv, overlaps_nucleus, px, py. Missing gene names are
    ``NaN``, missing cells -1, as is the custom of the format; coordinates are cut towards zero to pixels.
    """
    t = table(spark, d, "transcripts").select(
        "transcript_id",
        "ingested_at",
        "x",
        "y",
        number(F.col("z")).alias("z"),
        F.coalesce(clean_name(F.col("feature_name")), F.lit(NO_GENE)).alias("gene"),
        F.coalesce("cell_id", F.lit(NO_CELL)).alias("cell_id"),
        number(F.col("qv")).alias("qv"),
        "overlaps_nucleus",
    )
    t = latest_rows(t, "transcript_id", "ingested_at", ["x", "y", "z", "gene", "cell_id", "qv", "overlaps_nucleus"])
    return t.withColumn("px", F.col("x").cast("int")).withColumn("py", F.col("y").cast("int"))


CELL_COLUMNS = ["sample", "celltype", "x", "y", "cell_area", "nucleus_area", "transcript_counts", "control_probe_counts", "control_codeword_counts", "leiden"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per cell with its observed columns; repeated rows are one."""
    t = table(spark, d, "cell_table").where(F.col("cell_id").isNotNull())
    reals = {"x", "y", "cell_area", "nucleus_area"}
    return t.select("cell_id", *[number(F.col(c)).alias(c) if c in reals else F.col(c) for c in CELL_COLUMNS]).distinct()


def expression(tx: DataFrame) -> DataFrame:
    """Counts by cell and gene, non-zero ones only: cell_id, gene, n."""
    return tx.where((F.col("cell_id") != NO_CELL) & (F.col("gene") != NO_GENE)).groupBy("cell_id", "gene").agg(F.count(F.lit(1)).alias("n"))


def rings(spark: SparkSession, d: str) -> DataFrame:
    """cell_id and ring of the cells whose ring has at least three finite vertices."""
    good = F.forall("ring", lambda v: F.coalesce(~F.isnan(v["x"]) & ~F.isnan(v["y"]), F.lit(False)))
    return table(spark, d, "cell_boundaries").where((F.size("ring") >= 3) & good).select("cell_id", "ring")


def genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gene_panel")


def annotation(spark: SparkSession, d: str) -> DataFrame:
    """cell_id and cleaned label; of several labels of a cell the least."""
    label = F.regexp_replace("cluster", "[^A-Za-z0-9]", "")
    cell = F.regexp_extract("barcode", r"^cell_(\d+)$", 1)
    t = table(spark, d, "annotation").select(F.when(cell != "", cell).cast("long").alias("cell_id"), label.alias("label"))
    return t.where(F.col("cell_id").isNotNull() & (F.col("label") != "")).groupBy("cell_id").agg(F.min("label").alias("label"))
