"""From metrics to probabilities of good quality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histolith.operators import tabular as T
from histolith.operators.graphs import neighbour_share


def normal_pdf(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def tail_prior(df: DataFrame, value: str, target: str, *, threshold: float, sd: float, tail: str = "left") -> DataFrame:
    """1 minus the normal density around ``threshold``, where the whole tail counts as 1, scaled to [0, 1]."""
    x = F.col(value)
    beyond = x < threshold if tail == "left" else x > threshold
    p = 1.0 - F.when(beyond, 1.0).otherwise(normal_pdf(x, threshold, sd))
    return T.min_max(df.withColumn("_p", p), "_p", target).drop("_p")


def distance_prior(df: DataFrame, distance: str, target: str, *, sd: float = 100.0) -> DataFrame:
    """1 minus the scaled density of the distance to the nearest doublet; 1 where there is none, or none at all."""
    p = T.min_max(df.withColumn("_p", normal_pdf(F.col(distance), 0.0, sd)), "_p", "_s")
    return p.withColumn(target, F.coalesce(1.0 - F.col("_s"), F.lit(1.0))).drop("_p", "_s")


def combine(df: DataFrame, priors: list[str], target: str) -> DataFrame:
    """Sum of priors, scaled to [0, 1]."""
    total = sum((F.col(p) for p in priors[1:]), F.col(priors[0]))
    return T.min_max(df.withColumn("_sum", total), "_sum", target).drop("_sum")


def molecule_priors(structure: DataFrame, quality: DataFrame, ambient: DataFrame) -> DataFrame:
    """px, py, the three priors p_structure, p_quality, p_ambient, and their scaled sum ``p``, of every pixel.

    ``structure`` holds p_structure, ``quality`` the density of quality values (qv_density), ``ambient`` that of spatial
    patterns (ac_density); the latter two turn to probabilities above 20 and 0.4.
    """
    q = tail_prior(quality.select("px", "py", "qv_density"), "qv_density", "p_quality", threshold=20.0, sd=3.0)
    a = tail_prior(ambient.select("px", "py", "ac_density"), "ac_density", "p_ambient", threshold=0.4, sd=1.0)
    joined = structure.select("px", "py", "p_structure").join(q, ["px", "py"]).join(a, ["px", "py"])
    return combine(joined, ["p_structure", "p_quality", "p_ambient"], "p").select("px", "py", "p_structure", "p_quality", "p_ambient", "p")


def bad_cluster_flags(cells: DataFrame, cluster: str, value: str, *, least_mean: float = 1.0) -> DataFrame:
    """cells with ``bad``: 1 in the level (low, mid, high thirds of clusters) of least mean, or below ``least_mean`` where that level's mean is above it."""
    means = cells.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.avg(value).alias("_m"))
    levels = T.thirds(means, cluster, "_m").select(cluster, F.col("level").alias("_level"))
    marked = cells.join(F.broadcast(levels), cluster, "left")  # one row per cluster
    by_level = marked.where(F.col("_level").isNotNull()).groupBy("_level").agg(F.avg(value).alias("_lm"))
    worst = by_level.agg(F.min_by("_level", F.struct("_lm", "_level")).alias("_worst"), F.min("_lm").alias("_least"))
    flag = F.when(F.col("_least") > least_mean, F.col("_level") == F.col("_worst")).otherwise(F.col(value) < least_mean)
    return T.one_row(marked, worst).withColumn("bad", F.coalesce(flag, F.lit(False)).cast("int")).select(*cells.columns, "bad")


def good_neighbour_prior(cells: DataFrame, flag: str = "bad", radius: float = 30.0) -> DataFrame:
    return neighbour_share(cells, F.col(flag) == 1, radius=radius).select("cell_id", (1.0 - F.col("share")).alias("p_good"))


def celltype_bounds(cells: DataFrame, metrics: list[str], *, flags: str = "artefact", enough: int = 100) -> DataFrame:
    """celltype, metric, low, high: bounds between clean cells (``none``), doublets (``doublet``) and cells without nucleus (``nucleus_free``).

    With more than ``enough`` doublets, and more than ``enough`` or no nucleus-free cells, the upper bound is median - MAD
    of the doublets; with more than ``enough`` nucleus-free cells, and more than ``enough`` or no doublets, the lower bound is median + MAD of
    those. Other bounds are median -+ MAD of the clean cells, and 0 where there is none.
    """
    kinds = cells.where(F.col("celltype").isNotNull())
    long = kinds.select("celltype", F.col(flags).alias("_flag"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e"))
    long = long.select("celltype", "_flag", "e.metric", "e.v").where(F.col("v").isNotNull())
    by = ["celltype", "metric", "_flag"]
    stats = T.median_mad(long, "v", by).join(long.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    of = lambda flag, value: F.max(F.when(F.col("_flag") == flag, F.col(value)))
    columns = [of(flag, c).alias(f"_{c}_{flag}") for flag in ("none", "doublet", "nucleus_free") for c in ("low", "high", "n")]
    w = stats.groupBy("celltype", "metric").agg(*columns)
    n = lambda flag: F.coalesce(F.col(f"_n_{flag}"), F.lit(0))
    clear = lambda flag, other: (n(flag) > enough) & ((n(other) > enough) | (n(other) == 0))
    none = n("none") == 0
    low = F.when(none, 0.0).when(clear("nucleus_free", "doublet"), F.col("_high_nucleus_free")).otherwise(F.col("_low_none"))
    high = F.when(none, 0.0).when(clear("doublet", "nucleus_free"), F.col("_low_doublet")).otherwise(F.col("_high_none"))
    return w.select("celltype", "metric", low.alias("low"), high.alias("high"))


def outside_bounds(cells: DataFrame, bounds: DataFrame, metric: str) -> DataFrame:
    """cells with ``outside``: 1 where the metric lies outside of the bounds of its cell type."""
    b = bounds.where(F.col("metric") == metric).select("celltype", "low", "high")
    out = (F.col(metric) < F.col("low")) | (F.col(metric) > F.col("high"))
    return cells.join(b, "celltype", "left").withColumn("outside", F.coalesce(out, F.lit(False)).cast("int")).drop("low", "high")


def mixture_1d(values: np.ndarray, components: int = 3, rounds: int = 500, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a one-dimensional Gaussian mixture, started at the quantiles; for a few hundred values."""
    x = np.sort(np.asarray(values, float))
    k = min(components, len(x))
    mean = np.quantile(x, (np.arange(k) + 0.5) / k)
    var, weight = np.full(k, x.var() / k + floor), np.full(k, 1 / k)
    for _ in range(rounds):
        log = np.log(weight) - 0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * np.pi * var))
        r = np.exp(log - log.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        n = r.sum(0) + 1e-12
        new = (r * x[:, None]).sum(0) / n
        var = (r * (x[:, None] - new) ** 2).sum(0) / n + floor
        weight = n / n.sum()
        if np.abs(new - mean).max() < 1e-10:
            mean = new
            break
        mean = new
    return weight, mean, var


def pixel_prior(scores: DataFrame, score: str, target: str, *, spread: float = 6.0, threshold: float | None = None, most: int = 10_000) -> DataFrame:
    """Density of each cluster's score under the component of highest mean, widened ``spread`` times.

    ``scores`` has one row per cluster, at most ``most``. The standard deviation is the root of the variance divided by the
    number of components, as the method defines it; with a ``threshold`` that is the mean and 1 the deviation.
    """
    if threshold is None:
        rows = scores.select(F.col(score).cast("double")).where(F.col(score).isNotNull()).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("one row per cluster is expected")
        _, mean, var = mixture_1d(np.array([r[0] for r in rows])) if rows else (None, np.array([0.0]), np.array([1.0]))
        top = int(np.argmax(mean))
        mu, sd = float(mean[top]), math.sqrt(float(var[top]) / len(mean))
    else:
        mu, sd = threshold, 1.0
    return scores.withColumn(target, normal_pdf(F.col(score), mu, spread * sd))
