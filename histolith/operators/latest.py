"""The row that counts of each key: the one ingested last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: White space that may surround a name.
BLANKS = " \t\n\r\f\x0b 　"


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """``key`` and ``columns`` of the row with the greatest ``version`` of every key.

    One shuffle of exactly the named columns; within a task Spark keeps only the first
    row of each key. Defined cases: rows with a null key are dropped; a null version is the
    oldest; equal versions are decided by the greatest values of ``columns`` in order, so
    the result does not depend on the order of rows.
    """
    order = [F.col(version).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns if c != version]]
    ranked = df.select(key, version, *[c for c in columns if c not in (key, version)]).where(F.col(key).isNotNull())
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).select(key, *[c for c in columns if c != key])


def clean_name(col, missing: tuple[str, ...] = ("NaN",)):
    """A name without white space at its ends; null where that is empty or a text for "missing"."""
    name = F.btrim(col, F.lit(BLANKS))
    return F.when(~name.isin("", *missing), name)
