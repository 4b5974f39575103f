"""Geometry of rings: built-in array functions where they suffice, Arrow batches for clipping and hulls.

A ring is array<struct<x,y>>, open or closed; the last vertex joins the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histolith.operators.proximity import points_in_rings
from histolith.session import ship_package


def open_ring(ring: Column) -> Column:
    """The ring without a repeated first vertex at its end."""
    n = F.size(ring)
    closed = (n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
    return F.when(closed, F.slice(ring, 1, F.greatest(n - 1, F.lit(0)))).otherwise(ring)


def _sum_edges(ring: Column, term) -> Column:
    n = F.size(ring)
    step = lambda acc, i: acc + term(F.get(ring, i), F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1)))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), step)).otherwise(F.lit(0.0))


def signed_area(ring: Column) -> Column:
    return _sum_edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum_edges(ring, lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))


def thinness(ring: Column) -> Column:
    """4 pi area / perimeter squared: 1 for a circle, null for a ring without length."""
    p = perimeter(ring)
    return F.try_divide(4 * F.pi() * area(ring), p * p)


def centroid(ring: Column) -> Column:
    """Area-weighted centre as struct<x,y>; null for a ring without area."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    six = 6 * signed_area(ring)
    x = F.try_divide(_sum_edges(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)), six)
    y = F.try_divide(_sum_edges(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)), six)
    return F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def convexity(ring: Column, closed: bool = True) -> Column:
    """Share of turns in the more frequent direction, of all vertices of the closed ring.

    With ``closed`` the repeated vertex counts, whose two turns are straight, so a convex k-gon scores (k-1)/(k+1);
    without it a convex ring scores 1.
    """
    base = open_ring(ring)
    r = F.concat(base, F.slice(base, 1, 1)) if closed else base
    n = F.size(r)
    wrap = lambda i: F.get(r, F.when(i >= n, i - n).otherwise(i))

    def turn(i: Column) -> Column:
        a, b, c = wrap(i), wrap(i + 1), wrap(i + 2)
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    turns = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), turn)
    left, right = F.size(F.filter(turns, lambda t: t > 0)), F.size(F.filter(turns, lambda t: t < 0))
    return F.when(F.size(base) >= 3, F.greatest(left, right) / n)


def snap_to_pixels(ring: Column, x0: int, y0: int, width: int, height: int) -> Column:
    """Vertices cut towards zero, moved so that (x0, y0) is pixel (1, 1); those outside the extent are dropped."""
    moved = F.transform(ring, lambda v: F.struct((v["x"].cast("int") - (x0 - 1)).alias("x"), (v["y"].cast("int") - (y0 - 1)).alias("y")))
    return F.filter(moved, lambda v: (v["x"] >= 0) & (v["x"] < width) & (v["y"] >= 0) & (v["y"] < height))


# numpy kernels -----------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without collinear vertices."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]), float)


def is_simple(r: np.ndarray) -> bool:
    """No two edges cross or touch, apart from neighbours at their common vertex, and the ring has area."""
    n = len(r)
    if n < 3:
        return False
    a, b = r, np.roll(r, -1, 0)
    orient = lambda p, q, s: np.sign((q[..., 0] - p[..., 0]) * (s[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (s[..., 0] - p[..., 0]))
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    d1, d2, d3, d4 = orient(a[i], b[i], a[j]), orient(a[i], b[i], b[j]), orient(a[j], b[j], a[i]), orient(a[j], b[j], b[i])
    if ((d1 * d2 < 0) & (d3 * d4 < 0)).any():
        return False
    for d, p, q, s in ((d1, a[i], b[i], a[j]), (d2, a[i], b[i], b[j]), (d3, a[j], b[j], a[i]), (d4, a[j], b[j], b[i])):
        on = (d == 0) & (np.minimum(p, q) <= s).all(1) & (s <= np.maximum(p, q)).all(1)
        if on.any():
            return False
    return bool(abs((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum()) > 0)


def overlap(p: np.ndarray, q: np.ndarray) -> float:
    """Area common to two rings under the even-odd rule.

    Both rings are cut to trapezoids at every y where a vertex lies or edges cross; between two such levels edges run
    straight, so each slab contributes the mean of its common widths exactly.
    """
    def edges(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = r, np.roll(r, -1, 0)
        swap = a[:, 1] > b[:, 1]
        return np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)

    low, high = max(p[:, 1].min(), q[:, 1].min()), min(p[:, 1].max(), q[:, 1].max())
    if high <= low or p[:, 0].max() <= q[:, 0].min() or q[:, 0].max() <= p[:, 0].min():
        return 0.0
    (pa, pb), (qa, qb) = edges(p), edges(q)
    sa, sb = np.vstack([pa, qa]), np.vstack([pb, qb])
    ys = [p[:, 1], q[:, 1]]
    dx, dy = sb[:, 0] - sa[:, 0], sb[:, 1] - sa[:, 1]
    den = dx[:, None] * dy[None, :] - dy[:, None] * dx[None, :]
    wx, wy = sa[None, :, 0] - sa[:, None, 0], sa[None, :, 1] - sa[:, None, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (wx * dy[None, :] - wy * dx[None, :]) / den
        u = (wx * dy[:, None] - wy * dx[:, None]) / den
    hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    ys.append((sa[:, None, 1] + np.where(hit, t, 0.0) * dy[:, None])[hit])
    levels = np.unique(np.clip(np.concatenate(ys), low, high))

    def spans(a: np.ndarray, b: np.ndarray, y: float, mid: float) -> np.ndarray:
        use = (a[:, 1] <= mid) & (b[:, 1] > mid)
        at = lambda v: a[use, 0] + (v - a[use, 1]) / (b[use, 1] - a[use, 1]) * (b[use, 0] - a[use, 0])
        return at(y)[np.argsort(at(mid), kind="stable")].reshape(-1, 2)

    total = 0.0
    for y0, y1 in zip(levels, levels[1:]):
        mid = (y0 + y1) / 2
        for y in (y0, y1):
            for l0, h0 in spans(pa, pb, y, mid):
                for l1, h1 in spans(qa, qb, y, mid):
                    total += max(0.0, min(h0, h1) - max(l0, l1)) * (y1 - y0) / 2
    return total


def _array(ring) -> np.ndarray:
    r = np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2)
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def repair_rings(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """key, valid, ring: rings that cross or touch themselves are replaced by their convex hull.

    Rings with fewer than three distinct vertices, or null or NaN ones, are not valid and have a null ring.
    """
    ship_package(rings.sparkSession)
    kind = rings.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, ring_ in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                bad = ring_ is None or any(v is None or v["x"] is None or v["y"] is None for v in ring_)
                r = np.zeros((0, 2)) if bad else _array(ring_)
                if len(r) and not np.isfinite(r).all():
                    r = np.zeros((0, 2))
                valid = is_simple(r)
                fixed = r if valid else hull(r)
                out.append((k, valid, [{"x": x, "y": y} for x, y in fixed.tolist()] if len(fixed) >= 3 else None))
            yield pd.DataFrame(out, columns=[key, "valid", "ring"])

    return rings.select(key, F.col(ring).alias("ring")).mapInPandas(run, f"`{key}` {kind}, valid boolean, ring array<struct<x:double,y:double>>")


def ring_overlaps(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """``a`` < ``b``, ``overlap``: every pair of rings with a common area, once.

    Bounding boxes are hashed to grid cells as wide as the larger extent of the larger level; a pair is kept in the
    cell that holds the lower corner of the boxes' common part, so no pair needs to be made distinct.
    """
    ship_package(rings.sparkSession)
    kind = rings.schema[key].dataType.simpleString()
    xs, ys = F.transform("_ring", lambda v: v["x"]), F.transform("_ring", lambda v: v["y"])
    r = rings.where(F.size(ring) >= 3).select(F.col(key).alias("_k"), F.col(ring).alias("_ring"))
    r = r.select("_k", "_ring", F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"), F.array_min(ys).alias("_y0"), F.array_max(ys).alias("_y1"))
    r = r.where((F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0")))
    r = r.withColumn("_level", F.ceil(F.log2(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))).cast("int"))
    levels = sorted(row[0] for row in r.select("_level").distinct().collect())  # bounded by the exponents of a double

    def cells(df: DataFrame, own_only: bool) -> DataFrame:
        if own_only:
            df = df.withColumn("_grid", F.col("_level"))
        else:  # a ring is looked up at its own and every coarser level
            df = df.withColumn("_grid", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>"), lambda v: v >= F.col("_level"))))
        w = F.pow(F.lit(2.0), F.col("_grid"))
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / w).cast("long"), F.floor(F.col(hi) / w).cast("long"))
        return df.withColumn("_gx", F.explode(span("_x0", "_x1"))).withColumn("_gy", F.explode(span("_y0", "_y1")))

    a = cells(r, True).select("_grid", "_gx", "_gy", *[F.col(c).alias("a" + c) for c in ("_k", "_ring", "_x0", "_x1", "_y0", "_y1", "_level")])
    b = cells(r, False).select("_grid", "_gx", "_gy", *[F.col(c).alias("b" + c) for c in ("_k", "_ring", "_x0", "_x1", "_y0", "_y1", "_level")])
    w = F.pow(F.lit(2.0), F.col("_grid"))
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    once = (F.floor(x0 / w) == F.col("_gx")) & (F.floor(y0 / w) == F.col("_gy"))
    touching = (x0 < F.least("a_x1", "b_x1")) & (y0 < F.least("a_y1", "b_y1"))
    first = (F.col("a_level") > F.col("b_level")) | ((F.col("a_level") == F.col("b_level")) & (F.col("a_k") < F.col("b_k")))
    pairs = a.join(b, ["_grid", "_gx", "_gy"]).where(once & touching & first & (F.col("a_k") != F.col("b_k"))).select("a_k", "b_k", "a_ring", "b_ring")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(min(k, m), max(k, m), overlap(_array(p), _array(q))) for k, m, p, q in pdf.itertuples(index=False)]
            out = pd.DataFrame(got, columns=["a", "b", "overlap"])
            yield out[out["overlap"] > 1e-12]

    return pairs.mapInPandas(run, f"a {kind}, b {kind}, overlap double")


def overlap_area(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """key, overlap_area: area that each ring shares with others, summed over the others; 0 included."""
    pairs = ring_overlaps(rings, key, ring)
    both = pairs.select(F.explode(F.array("a", "b")).alias(key), "overlap").groupBy(key).agg(F.sum("overlap").alias("overlap_area"))
    return rings.select(key).distinct().join(both, key, "left").fillna(0.0, ["overlap_area"])


def contained_points(points: DataFrame, rings: DataFrame, point_key: str, ring_key: str) -> DataFrame:
    """ring_key, members: sorted keys of the points inside of each ring; empty where there is none."""
    found = points_in_rings(points, rings, point_key=point_key, ring_key=ring_key).groupBy(ring_key).agg(F.sort_array(F.collect_set(point_key)).alias("members"))
    kind = points.schema[point_key].dataType.simpleString()
    return rings.select(ring_key).distinct().join(found, ring_key, "left").select(ring_key, F.coalesce("members", F.array().cast(f"array<{kind}>")).alias("members"))
