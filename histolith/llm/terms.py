"""Frequency of every distinct term, by last-seen counters.

Tokens are hash-partitioned by (term, slice of the record space) and ordered by record.
Walking over a partition in that order a term needs three numbers only: its occurrences,
its records and the record it was seen in last; a token opens a new record exactly when its
record differs from the last one. No set of records is ever held, whatever the term's
frequency. The walk is a ``lag`` over the sorted partition, so it stays in the JVM, and
the slices bound the share of one task: a term that makes up a third of all tokens is spread
over ``slices`` groups. As a record lies in one slice only, the slices' counts simply add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the record space by which each term is split, at least; more on a cluster that shuffles to more partitions.
SLICES, SLICES_A_PARTITION = 64, 4


def term_frequencies(tokens: DataFrame, term: str | Column, record: str | Column, *, slices: int | None = None) -> DataFrame:
    """Columns ``term``, ``occurrences``, ``records`` of every distinct term.

    Defined cases: tokens whose term is null are left out; a null record counts as an
    occurrence in no record; repeated rows are occurrences of their own in one record; an
    empty input gives no rows; other columns are ignored.
    """
    if slices is None:
        slices = max(SLICES, SLICES_A_PARTITION * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    term = F.col(term) if isinstance(term, str) else term
    record = F.col(record) if isinstance(record, str) else record
    t = tokens.select(term.alias("term"), record.alias("_record")).where(F.col("term").isNotNull())
    t = t.withColumn("_slice", F.pmod(F.xxhash64("_record"), F.lit(slices)))
    # Tokens without a record all hash alike; they are spread by their place, as their slice decides nothing.
    t = t.withColumn("_slice", F.when(F.col("_record").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(slices))).otherwise(F.col("_slice")))
    seen = Window.partitionBy("term", "_slice").orderBy(F.col("_record").asc_nulls_first())
    opens = F.col("_record").isNotNull() & ~F.col("_record").eqNullSafe(F.lag("_record").over(seen))
    return (
        t.withColumn("_opens", opens)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.sum(F.col("_opens").cast("long")).alias("records"))
    )


def distinct_records(tokens: DataFrame, record: str | Column) -> DataFrame:
    """One row ``total``: the number of distinct non-null records."""
    record = F.col(record) if isinstance(record, str) else record
    return tokens.select(record.alias("_record")).where(F.col("_record").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("total"))


def mark_terms(counts: DataFrame, total: DataFrame, *, rare_below: int, common_above: float, rare_by: str = "occurrences") -> DataFrame:
    """``term``, ``mark``: ``rare`` below a count, ``common`` above a share of all records.

    ``total`` is a one-row frame, so its broadcast is bounded. A term may carry both marks in
    a tiny collection and then has two rows; a term with neither has none.
    """
    marks = F.array_compact(
        F.array(
            F.when(F.col(rare_by) < rare_below, F.lit("rare")),
            F.when(F.col("records") > F.col("total") * common_above, F.lit("common")),
        )
    )
    return counts.crossJoin(F.broadcast(total)).select("term", F.explode(marks).alias("mark"))
