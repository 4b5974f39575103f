"""Percentiles of very large numeric columns, by mergeable compactor sketches.

A KLL sketch is a hierarchy of compactors: a full level is sorted and every other value,
starting at a random one of the first two, moves up with double weight. Its size hardly
grows with the input, sketches of parts merge level by level, and the rank of an answer is off
by at most ``rank_error(k)`` of the count with 99 % probability. Spark's built-in KLL
aggregates hold, merge and serialise these hierarchies in the JVM with map-side combine, so
a group of a third of all rows arrives at its reducer as a few kilobytes per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketches; the rank error falls almost in proportion to it.
K = 800
#: Multiple of the 99 % rank error beyond which a sketch's answer is taken as decided.
DOUBT = 3.0


def rank_error(k: int = K) -> float:
    """Normalised single-sided rank error at 99 % confidence, the published fit for KLL."""
    return 2.296 / k**0.9723


def usable(col: Column) -> Column:
    """The value as a double, or null where it is null or NaN."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def sketch(df: DataFrame, keys: list[str], measures: list[str], *, k: int = K) -> DataFrame:
    """One row per group: for every measure ``<m>_sketch`` and ``<m>_n``.

    Null and NaN values are not counted; a group without values has a null sketch and n 0.
    """
    aggs: list[Column] = []
    for m in measures:
        value = usable(F.col(m))
        aggs += [F.kll_sketch_agg_double(value, F.lit(k)).alias(f"{m}_sketch"), F.count(value).alias(f"{m}_n")]
    return df.groupBy(*keys).agg(*aggs)


def merge(sketches: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Combine separately computed sketches (days, partitions) to coarser groups."""
    aggs: list[Column] = []
    for m in measures:
        aggs += [F.kll_merge_agg_double(F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sketch"))).alias(f"{m}_sketch"), F.sum(f"{m}_n").alias(f"{m}_n")]
    return sketches.groupBy(*keys).agg(*aggs)


def quantiles(sketches: DataFrame, keys: list[str], measures: list[str], shares: list[float], *, k: int = K) -> DataFrame:
    """Long form: keys, ``measure``, ``n``, ``share``, ``estimate``, ``rank_error``; groups without values have no rows."""
    entries = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"{m}_n").alias("n"),
            F.lit(float(q)).alias("share"),
            F.when(F.col(f"{m}_n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{m}_sketch"), F.lit(float(q)))).alias("estimate"),
        )
        for m in measures
        for q in shares
    ]
    out = sketches.select(*keys, F.explode(F.array(*entries)).alias("_e")).where(F.col("_e.n") > 0)
    return out.select(*keys, "_e.measure", "_e.n", "_e.share", "_e.estimate", F.lit(rank_error(k)).alias("rank_error"))


def percentile_tests(
    df: DataFrame, keys: list[str], tests: list[tuple[str, float, str, float]], *, least: int = 1, k: int = K
) -> DataFrame:
    """Groups whose percentile lies beyond a bound: keys, ``measure``.

    ``tests`` holds (measure, share, "<" or ">", bound); the percentile interpolates
    linearly between neighbours. The sketch of each group gives the rank of the bound. Where
    that rank is farther from the share than the sketch's error the case is decided by it;
    only groups in doubt are checked on their values, by counting values beside the bound and
    taking the two values next to it, which is a plain aggregate with map-side combine and
    never sorts or holds a group.

    ``df`` is read twice and should therefore be a table. Defined cases: groups with fewer
    than ``least`` values are left out; null keys form a group of their own.
    """
    measures = list(dict.fromkeys(m for m, *_ in tests))
    sk = sketch(df, keys, measures, k=k)
    cases = []
    for i, (m, share, sign, bound) in enumerate(tests):
        n = F.col(f"{m}_n")
        # The sketch ranks inclusively: values equal to the bound are not below it, but they are not above it either.
        at = math.nextafter(bound, -math.inf) if sign == "<" else float(bound)
        rank = F.when(n > 0, F.kll_sketch_get_rank_double(F.col(f"{m}_sketch"), F.lit(at)))
        # Up to k values nothing has been compacted and the rank is exact; interpolation then reaches over one value on each side.
        margin = F.when(n <= k, 0.0).otherwise(DOUBT * rank_error(k)) + F.lit(1.0) / F.greatest(n, F.lit(1))
        below = rank > share + margin  # enough values are below the bound
        above = rank < share - margin
        verdict = F.when(below, F.lit(sign == "<")).when(above, F.lit(sign == ">"))
        cases.append(F.struct(F.lit(i).alias("test"), n.alias("n"), verdict.alias("verdict")))
    from histolith.session import materialize

    judged = materialize(
        sk.select(*keys, F.explode(F.array(*cases)).alias("_c")).where(F.col("_c.n") >= least).select(*keys, "_c.test", "_c.verdict"), "percentile-cases"
    )
    decided = judged.where(F.col("verdict")).select(*keys, "test")
    doubtful = judged.where(F.col("verdict").isNull()).groupBy(*keys).agg(F.collect_set("test").alias("_tests"))

    marks = [f"_k{i}" for i in range(len(keys))]
    asked = doubtful.select(*[F.col(c).alias(a) for c, a in zip(keys, marks)], "_tests")
    same = F.lit(True)
    for c, a in zip(keys, marks):
        same = same & F.col(c).eqNullSafe(F.col(a))
    rows = df.join(asked, same, "left_semi")
    aggs: list[Column] = []
    for i, (m, share, sign, bound) in enumerate(tests):
        v = usable(F.col(m))
        aggs += [
            F.count(v).alias(f"_n{i}"),
            F.sum((v < bound).cast("long")).alias(f"_lt{i}"),
            F.sum((v <= bound).cast("long")).alias(f"_le{i}"),
            F.max(F.when(v < bound, v)).alias(f"_below{i}"),
            F.min(F.when(v >= bound, v)).alias(f"_from{i}"),
            F.max(F.when(v <= bound, v)).alias(f"_upto{i}"),
            F.min(F.when(v > bound, v)).alias(f"_above{i}"),
        ]
    exact = rows.groupBy(*keys).agg(*aggs).join(asked, same, "inner")
    verdicts = []
    for i, (m, share, sign, bound) in enumerate(tests):
        place = (F.col(f"_n{i}") - 1) * F.lit(float(share))
        low, part = F.floor(place), place - F.floor(place)
        high = low + (part > 0).cast("long")
        if sign == "<":
            n_lt = F.col(f"_lt{i}")
            mixed = F.col(f"_below{i}") + part * (F.col(f"_from{i}") - F.col(f"_below{i}")) < bound
            holds = F.when(high < n_lt, F.lit(True)).when(low >= n_lt, F.lit(False)).otherwise(mixed)
        else:
            n_le = F.col(f"_le{i}")
            mixed = F.col(f"_upto{i}") + part * (F.col(f"_above{i}") - F.col(f"_upto{i}")) > bound
            holds = F.when(low >= n_le, F.lit(True)).when(high < n_le, F.lit(False)).otherwise(mixed)
        verdicts.append(F.struct(F.lit(i).alias("test"), (holds & F.array_contains("_tests", i)).alias("holds")))
    checked = exact.select(*keys, F.explode(F.array(*verdicts)).alias("_v")).where(F.col("_v.holds")).select(*keys, "_v.test")
    names = F.array(*[F.lit(m) for m, *_ in tests])
    return decided.unionByName(checked).select(*keys, F.get(names, F.col("test")).alias("measure"))
