"""Aggregates, windows and projections over cells, genes and molecules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row; its broadcast is a single row."""
    return df.crossJoin(F.broadcast(row))


def min_max(df: DataFrame, source: str, target: str) -> DataFrame:
    """``source`` scaled to [0, 1]; null where the column is constant or empty."""
    lo, hi = f"_{target}_lo", f"_{target}_hi"
    scaled = one_row(df, df.agg(F.min(source).alias(lo), F.max(source).alias(hi)))
    return scaled.withColumn(target, share(F.col(source) - F.col(lo), F.col(hi) - F.col(lo))).drop(lo, hi)


def shift_non_negative(df: DataFrame, source: str, target: str) -> DataFrame:
    low = df.agg(F.abs(F.least(F.min(source), F.lit(0.0))).alias("_low"))
    return one_row(df, low).withColumn(target, F.col(source) + F.col("_low")).drop("_low")


def group_fraction(df: DataFrame, by: str, of: str) -> DataFrame:
    """Share of every value of ``of`` within ``by``: by, of, n, fraction."""
    counts = df.groupBy(by, of).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def dense_group_fraction(df: DataFrame, by: str, of: str) -> DataFrame:
    """As ``group_fraction`` with a row of 0 for every combination that does not occur.

    Meant for categories: the grid is made of the distinct values of both columns.
    """
    grid = df.select(by).distinct().crossJoin(df.select(of).distinct())
    found = group_fraction(df, by, of).select(F.col(by).alias("_b"), F.col(of).alias("_o"), "n", "fraction")
    on = F.col(by).eqNullSafe(F.col("_b")) & F.col(of).eqNullSafe(F.col("_o"))
    return grid.join(found, on, "left").select(by, of, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts of ``bins`` equal bins over each group's [min, max], the last bin closed.

    Columns: by, bin (from 0), n, low, width; only bins that occur. The groups' ranges are an aggregate of their
    own, so the values themselves are counted with map-side combine. A constant column is in bin 0.
    """
    by = by or []
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranges = kept.groupBy(*by).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("_high"))
    joined = kept.join(ranges, by) if by else one_row(kept, ranges)
    place = F.floor(F.coalesce(share(F.col(value) - F.col("low"), F.col("_high") - F.col("low")), F.lit(0.0)) * bins)
    joined = joined.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int")).withColumn("width", (F.col("_high") - F.col("low")) / bins)
    return joined.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("low").alias("low"), F.first("width").alias("width"))


def mode_midpoint(df: DataFrame, value: str, bins: int = 100, digits: int = 3) -> DataFrame:
    """One row ``midpoint``: the middle of the fullest bin, the first of equal ones."""
    best = histogram(df, value, bins).agg(F.max_by(F.struct("bin", "low", "width"), F.struct("n", -F.col("bin"))).alias("b"))
    return best.select(F.bround(F.col("b.low") + (F.col("b.bin") + 0.5) * F.col("b.width"), digits).alias("midpoint"))


def density_divergence(df: DataFrame, value: str, group: str, first: str, second: str, bins: int = 100, eps: float = 1e-10) -> DataFrame:
    """One row ``divergence``: Kullback-Leibler divergence of two groups' density histograms.

    Each histogram has its own range; bins are compared by number, and ``eps`` is added to each density.
    """
    h = histogram(df.where(F.col(group).isin(first, second)), value, bins, [group])
    total = Window.partitionBy(group)
    h = h.withColumn("density", share(F.col("n"), F.sum("n").over(total) * F.col("width")))
    side = lambda g, name: h.where(F.col(group) == g).select("bin", F.col("density").alias(name))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = grid.join(side(first, "p"), "bin", "left").join(side(second, "q"), "bin", "left").fillna(0.0, ["p", "q"])
    return both.agg(F.sum((F.col("p") + eps) * F.ln((F.col("p") + eps) / (F.col("q") + eps))).alias("divergence"))


def median_mad(df: DataFrame, value: str, by: list[str], width: float = 1.0) -> DataFrame:
    """median, mad, low and high (median -+ width * mad) of each group; exact percentiles."""
    med = df.groupBy(*by).agg(F.median(value).alias("median"))
    dev = df.join(med, by) if by else one_row(df, med)
    mad = dev.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.first("median").alias("median"))
    return mad.select(*by, "median", "mad", (F.col("median") - width * F.col("mad")).alias("low"), (F.col("median") + width * F.col("mad")).alias("high"))


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None, more_than: int = 0) -> DataFrame:
    """Pearson's r and number of complete pairs of each group with more than ``more_than`` of them."""
    kept = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return kept.groupBy(*(by or [])).agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def cell_qc(expr: DataFrame, genes: DataFrame, tops: tuple[int, ...] = (10, 20, 50, 150)) -> DataFrame:
    """Per cell: total_counts, n_genes, pct_mt, pct_ribo and pct_top_N of its most frequent genes."""
    flags = genes.select("gene", F.col("gene").startswith("MT-").alias("_mt"), (F.col("gene").startswith("RPS") | F.col("gene").startswith("RPL")).alias("_ribo"))
    order = Window.partitionBy("cell_id").orderBy(F.col("n").desc(), "gene")
    e = expr.join(flags, "gene", "left").withColumn("_rank", F.row_number().over(order))
    total = F.sum("n")
    pct = lambda c: F.coalesce(share(F.sum(F.when(c, F.col("n")).otherwise(0)), total), F.lit(0.0)) * 100
    return e.groupBy("cell_id").agg(
        total.alias("total_counts"),
        F.count(F.lit(1)).alias("n_genes"),
        pct(F.coalesce("_mt", F.lit(False))).alias("pct_mt"),
        pct(F.coalesce("_ribo", F.lit(False))).alias("pct_ribo"),
        *[pct(F.col("_rank") <= n).alias(f"pct_top_{n}") for n in tops],
    )


def thirds(means: DataFrame, key: str, value: str) -> DataFrame:
    """``level`` of each key by rank: the first n//3 are low, up to 2n//3 mid, the rest high."""
    order = Window.orderBy(value, key)  # a handful of clusters
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = F.row_number().over(order) - 1
    return means.withColumn("level", F.when(r < F.floor(n / 3), "low").when(r < F.floor(2 * n / 3), "mid").otherwise("high"))


def three_set_venn(df: DataFrame, a: str, b: str, c: str, digits: int = 3) -> DataFrame:
    """Share of rows in each exclusive combination of three 0/1 masks, absent ones as 0."""
    grid = df.sparkSession.createDataFrame([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)], f"{a} int, {b} int, {c} int")
    counts = df.groupBy(F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b), F.col(c).cast("int").alias(c)).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    joined = one_row(F.broadcast(grid).join(counts, [a, b, c], "left"), total)
    return joined.select(a, b, c, F.round(F.coalesce(share(F.col("_n"), F.col("_total")), F.lit(0.0)), digits).alias("fraction"))


def bootstrap_means(df: DataFrame, by: str, value: str, rounds: int = 1000, seed: int = 123) -> DataFrame:
    """95 % interval of the mean of each group by Poisson resampling: by, mean, low, high.

    Each row draws its multiplicity in every round from a Poisson law of mean 1 by the hash of its
    own key, so the resampling needs no group in memory and combines map-side.
    """
    kept = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_h"))
    u = F.pmod(F.xxhash64("_h", "_round", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    bounds = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    times = sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    drawn = kept.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_m", times)
    means = drawn.groupBy(by, "_round").agg(share(F.sum(F.col("_m") * F.col("_v")), F.sum("_m")).alias("_mean"))
    spread = means.groupBy(by).agg(F.percentile("_mean", F.lit(0.025)).alias("low"), F.percentile("_mean", F.lit(0.975)).alias("high"))
    return kept.groupBy(by).agg(F.avg("_v").alias("mean")).join(spread, by)
