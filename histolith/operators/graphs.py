"""Graphs over cells: neighbours, nearest records, components, communities."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histolith.operators.proximity import finite, near_pairs
from histolith.session import materialize


def radius_pairs(cells: DataFrame, radius: float, *, key: str = "cell_id", include_self: bool = False) -> DataFrame:
    """``src``, ``dst``, ``distance``, and the steps ``dx``, ``dy`` from src to dst, of all ordered pairs at most ``radius`` apart.

    ``cells`` has one row per key, as for all functions of this module; so no pair needs to be grouped.
    """
    pairs = near_pairs(cells, cells, radius, query_key=key, point_key=key, unique=True)
    pairs = pairs.select(F.col("_qid").alias("src"), F.col("_rid").alias("dst"), "distance", (F.col("_rx") - F.col("_qx")).alias("dx"), (F.col("_ry") - F.col("_qy")).alias("dy"))
    return pairs if include_self else pairs.where(F.col("src") != F.col("dst"))


def neighbour_counts(cells: DataFrame, radius: float, *, key: str = "cell_id") -> DataFrame:
    """key, neighbours: how many other records lie within the radius; 0 included."""
    n = radius_pairs(cells, radius, key=key).groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("neighbours"))
    return cells.select(key).distinct().join(n, key, "left").fillna(0, ["neighbours"])


def nearest(
    queries: DataFrame, points: DataFrame, *, query_key: str, point_key: str, by: str | None = None, within: float, first: float | None = None, x: str = "x", y: str = "y"
) -> DataFrame:
    """``query_key``, ``point_key``, ``distance`` of the nearest point less than ``within`` away, of equal ones the least key.

    With ``by`` only points of the same group count. The radius grows fourfold from ``first``; each round
    asks only for the queries that have no answer yet, so a dense region is never searched at the full
    radius. Null or non-finite coordinates have no answer.
    """
    first = within / 64 if first is None else first
    group = F.col(by) if by else F.lit(1)
    q = queries.select(F.col(query_key).alias("_q"), group.alias("_g"), F.col(x).cast("double").alias("_qx"), F.col(y).cast("double").alias("_qy")).where(finite(F.col("_qx"), F.col("_qy")))
    p = points.select(F.col(point_key).alias("_p"), group.alias("_g"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).where(finite(F.col("_px"), F.col("_py")))
    rounds = max(1, math.ceil(math.log(within / first, 4)) + 1)
    answers, left = [], q
    for i in range(rounds):
        r = min(within, first * 4**i)
        last = r >= within
        width = 2 * r
        cell = lambda c: F.floor(F.col(c) / width).cast("long")
        touch = lambda c: F.sequence(F.floor((F.col(c) - r) / width).cast("long"), F.floor((F.col(c) + r) / width).cast("long"))
        a = left.withColumn("_gx", F.explode(touch("_qx"))).withColumn("_gy", F.explode(touch("_qy")))
        b = p.withColumn("_gx", cell("_px")).withColumn("_gy", cell("_py"))
        gap = F.sqrt(F.pow(F.col("_qx") - F.col("_px"), 2) + F.pow(F.col("_qy") - F.col("_py"), 2))
        found = a.join(b, ["_g", "_gx", "_gy"]).withColumn("_d", gap).where(F.col("_d") < within if last else F.col("_d") <= r)
        best = found.groupBy("_q").agg(F.min(F.struct("_d", "_p")).alias("_m"))
        best = materialize(best.select("_q", F.col("_m._p").alias("_p"), F.col("_m._d").alias("_d")), "nearest")
        answers.append(best)
        if last:
            break
        left = materialize(left.join(best, "_q", "left_anti"), "unanswered")
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out.select(F.col("_q").alias(query_key), F.col("_p").alias(point_key), F.col("_d").alias("distance"))


def components(nodes: DataFrame, edges: DataFrame, *, key: str = "cell_id", rounds: int = 100) -> DataFrame:
    """key, component: the least key that can be reached from each node.

    Alternating star contraction: in a large star every larger neighbour of a node is linked to the node's least
    neighbour, in a small star the smaller ones are. The number of rounds is logarithmic in the
    diameter, rows shrink from round to round, and hub nodes are only ever aggregated by minimum.
    """
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where(F.col("u") < F.col("v")).distinct()
    e = materialize(e, "edges")
    mark = (e.count(), None)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where(F.col("u") < F.col("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("m", "u", "v")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("_e"))
        e = materialize(small.select("_e.u", "_e.v").where(F.col("u") < F.col("v")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy(F.col("v").alias(key)).agg(F.min("u").alias("_root"))
    return nodes.select(key).distinct().join(roots, key, "left").select(key, F.coalesce("_root", key).alias("component"))


def islands(cells: DataFrame, *, distance: float = 15.0, small: int = 10, key: str = "cell_id") -> DataFrame:
    """key, component, island_size, small_island: groups of cells linked by steps of at most ``distance``."""
    c = components(cells, radius_pairs(cells, distance, key=key), key=key)
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("island_size"))
    return c.join(sizes, "component").select(key, "component", "island_size", (F.col("island_size") < small).alias("small_island"))


def border_scores(cells: DataFrame, *, radius: float = 50.0, angles: int = 36, limit: float = 1.0, key: str = "cell_id") -> DataFrame:
    """key, border_score, border: the most one-sided split of the neighbours by a line through the cell.

    For each of ``angles`` directions the log2 ratio of neighbours before and behind the line; half of
    the directions are enough, as the opposite one has the same absolute value. One pass over the pairs.
    """
    pairs = radius_pairs(cells, radius, key=key).select("src", "dx", "dy")
    side = lambda k: F.round(F.col("dx") * round(math.cos(2 * math.pi * k / angles), 12) + F.col("dy") * round(math.sin(2 * math.pi * k / angles), 12), 9)
    aggs = []
    for k in range(angles // 2):
        aggs += [F.count_if(side(k) > 0).alias(f"p{k}"), F.count_if(side(k) < 0).alias(f"n{k}")]
    ratios = [F.abs(F.log2((F.col(f"p{k}") + 1) / (F.col(f"n{k}") + 1))) for k in range(angles // 2)]
    scored = pairs.groupBy("src").agg(*aggs).select(F.col("src").alias(key), F.greatest(*ratios).alias("border_score"))
    out = cells.select(key).distinct().join(scored, key, "left").fillna(0.0, ["border_score"])
    return out.withColumn("border", F.col("border_score") >= limit)


def neighbour_share(cells: DataFrame, flag: Column, *, radius: float = 30.0, key: str = "cell_id") -> DataFrame:
    """key, share: part of the other cells within the radius for which ``flag`` holds, 0 without neighbours."""
    flags = cells.select(F.col(key).alias("dst"), flag.cast("int").alias("_f"))
    s = radius_pairs(cells, radius, key=key).join(flags, "dst").groupBy(F.col("src").alias(key)).agg(F.avg("_f").alias("share"))
    return cells.select(key).distinct().join(s, key, "left").fillna(0.0, ["share"])


def marker_in_radius(cells: DataFrame, expr: DataFrame, markers: DataFrame, radii: list[int], *, key: str = "cell_id") -> DataFrame:
    """celltype, gene, radius, mean_of_means, n_cells: for the ``markers`` (celltype, gene), the mean over the cells of the type of the mean
    count in the other cells within each radius; cells without any neighbour in it do not count.

    Cells around are counted in rings once, at the widest radius; only counts of marker genes join the pairs.
    """
    ranked = sorted(radii)
    steps = F.explode(F.filter(F.array(*[F.lit(r) for r in ranked]), lambda r: r >= F.col("distance")))
    kinds = cells.where(F.col("celltype").isNotNull()).select(F.col(key).alias("src"), "celltype")
    pairs = materialize(radius_pairs(cells, float(ranked[-1]), key=key).select("src", "dst", "distance").join(kinds, "src"), "pairs-by-type")
    around = pairs.select("src", "celltype", steps.alias("radius")).groupBy("src", "celltype", "radius").agg(F.count(F.lit(1)).alias("around"))
    counted = expr.join(markers, "gene").select(F.col(key).alias("dst"), "celltype", "gene", "n")
    sums = pairs.join(counted, ["dst", "celltype"]).select("src", "gene", "n", steps.alias("radius")).groupBy("src", "gene", "radius").agg(F.sum("n").alias("total"))
    means = around.join(markers, "celltype").join(sums, ["src", "gene", "radius"], "left").select("celltype", "gene", "radius", (F.coalesce("total", F.lit(0)) / F.col("around")).alias("m"))
    return means.groupBy("celltype", "gene", "radius").agg(F.avg("m").alias("mean_of_means"), F.count(F.lit(1)).alias("n_cells"))


def communities(nodes: DataFrame, edges: DataFrame, *, key: str = "cell_id", rounds: int = 30) -> DataFrame:
    """key, community: label propagation over weighted edges (src, dst, weight in both directions).

    In each round a node takes the label of greatest total weight around it, its own label counting half of the heaviest
    edge so that pairs do not swap labels for ever; of equal ones the least. Stops when no label changes; a warning tells
    where that is not so after ``rounds``.
    """
    labels = materialize(nodes.select(F.col(key).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        own = labels.join(edges.groupBy(F.col("src").alias("id")).agg((F.max("weight") / 2).alias("w")), "id").select("id", "label", "w")
        total = votes.unionByName(own).groupBy("id", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = total.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new"))
        moved = materialize(labels.join(best, "id", "left").select("id", "label", F.coalesce("new", "label").alias("new")), "labels")
        changes = moved.where(F.col("label") != F.col("new")).count()
        labels = moved.select("id", F.col("new").alias("label"))
        if not changes:
            break
    else:
        warnings.warn(f"labels still change after {rounds} rounds", stacklevel=2)
    return labels.select(F.col("id").alias(key), F.col("label").alias("community"))


def moran(values: DataFrame, edges: DataFrame, nodes: DataFrame, *, key: str = "cell_id", by: str = "gene", value: str = "n") -> DataFrame:
    """by, morans_i, expected, variance (one value per key and ``by``): global autocorrelation over row-standardised neighbour weights.

    ``values`` holds the non-zero values only; zeros are put in by algebra: the sum over (x - m) (y - m) expands to sums over
    pairs of non-zeros, the neighbours' column sums and the number of nodes. Isolated nodes count in the mean. ``variance`` is that
    of the null hypothesis of normality.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    w = materialize(edges.select("src", "dst").join(degree, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")), "weights")
    n = nodes.select(key).distinct().count()
    columns = w.groupBy(F.col("dst").alias(key)).agg(F.sum("w").alias("c"))
    back = w.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("w2"))
    tot = w.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("w")).alias("ww")).first()
    cross = w.join(back, ["src", "dst"]).agg(F.sum(F.col("w") * F.col("w2")).alias("wc")).first()["wc"] or 0.0
    s0 = float(tot["s0"] or 0.0)
    s1 = float(tot["ww"] or 0.0) + float(cross)
    v = values.select(key, by, F.col(value).cast("double").alias("_x"))
    node = nodes.select(key).distinct().join(columns, key, "left").join(degree.select(F.col("src").alias(key), F.lit(1.0).alias("r")), key, "left").fillna(0.0, ["c", "r"])
    s2 = node.agg(F.sum(F.pow(F.col("c") + F.col("r"), 2))).first()[0] or 0.0
    own = v.join(node, key).groupBy(by).agg(F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("ss"), F.sum(F.col("_x") * F.col("c")).alias("xc"), F.sum(F.col("_x") * F.col("r")).alias("xr"))
    # A cell's values travel once per edge, as a map; the neighbours' weighted values meet the own ones in the cell.
    values_of = v.groupBy(F.col(key).alias("dst")).agg(F.map_from_entries(F.collect_list(F.struct(by, "_x"))).alias("_values"))
    lag = w.join(values_of, "dst").select("src", "w", F.explode("_values").alias(by, "xb")).groupBy("src", by).agg(F.sum(F.col("w") * F.col("xb")).alias("lag"))
    pair = lag.join(v.select(F.col(key).alias("src"), by, F.col("_x").alias("xa")), ["src", by]).groupBy(by).agg(F.sum(F.col("xa") * F.col("lag")).alias("xy"))
    m = F.col("s") / n
    top = F.coalesce("xy", F.lit(0.0)) - m * F.col("xr") - m * F.col("xc") + m * m * s0
    bottom = F.col("ss") - n * m * m
    expected = -1.0 / (n - 1) if n > 1 else 0.0
    var = (n * n * s1 - n * float(s2) + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected**2 if s0 and n > 1 else 0.0
    return own.join(pair, by, "left").select(by, (F.lit(n) * F.try_divide(top, bottom * s0)).alias("morans_i"), F.lit(expected).alias("expected"), F.lit(float(var)).alias("variance"))

