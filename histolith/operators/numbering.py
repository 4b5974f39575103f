"""Consecutive numbers over a distributed table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges by which a table is numbered in parallel.
RANGES = 256


def numbered(df: DataFrame, by: list[str], key: str, target: str, *, width: int | None = None) -> DataFrame:
    """``target`` counts the rows of each group from 1 in the order of an integer ``key``.

    A group may hold a third of all rows: keys are cut to ranges of equal width, rows are numbered within
    (group, range), and the ranges' offsets come from their counts.
    """
    if width is None:
        span = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
        width = 1 if span["a"] is None else max(1, -(-(span["b"] - span["a"] + 1) // RANGES))
    cut = df.withColumn("_range", F.floor(F.col(key) / F.lit(width)))
    counts = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    on = F.col("_range").eqNullSafe(F.col("_r"))
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    within = Window.partitionBy(*by, "_range").orderBy(key)
    rows = cut.withColumn("_row", F.row_number().over(within)).join(offsets, on)
    return rows.withColumn(target, F.col("_row") + F.col("_offset")).select(*df.columns, target)


def dense_ids(df: DataFrame, key: str, target: str) -> DataFrame:
    """``key`` and its place from 0 in the order of the keys."""
    return numbered(df.select(key).distinct(), [], key, "_place").select(key, (F.col("_place") - 1).alias(target))
