"""Delaunay triangles of cell centres, tile by tile, and the voids between cells.

A triangle is Delaunay where its circumcircle is empty, which only depends on points nearby. Tiles are triangulated
with a halo; a triangle is kept by the tile that holds the centre of its circumcircle, if the circle
reaches no farther than the halo. So every triangle is found once, whatever the tiles. What is then
uncovered, wide gaps and the rim of the section, has its corners among the points at edges of one triangle only: these
points are triangulated again with a halo four times as wide, and so on, until one tile holds what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histolith.operators import tabular as T
from histolith.operators.graphs import components
from histolith.operators.proximity import finite, points_in_rings
from histolith.session import materialize, ship_package


def circumcircles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of triangles."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    u, v = b - a, c - a
    den = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / den, (u[:, 0] * vv - v[:, 0] * uu) / den], axis=1)
    flat = den == 0
    off[flat] = np.inf
    return a + off, np.where(flat, np.inf, (off * off).sum(1))


def triangulate(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three places) by incremental insertion; points must be distinct.

    Points are inserted in the order given; the triangles whose circle holds the new point are removed and the
    hole is filled by a fan. Ties of more than three points on a circle are split in some way.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    mid, span = (points.max(0) + points.min(0)) / 2, max(float(np.ptp(points, axis=0).max()), 1.0)
    far = mid + span * np.array([[-50.0, -30.0], [50.0, -30.0], [0.0, 60.0]])
    p = np.vstack([points, far])
    tri = np.full((2 * n + 16, 3), -1, np.int64)
    centre, radius = np.zeros((len(tri), 2)), np.full(len(tri), -1.0)
    tri[0] = (n, n + 1, n + 2)
    centre[:1], radius[:1] = circumcircles(p, tri[:1])
    used = 1
    free: list[int] = []
    for i in range(n):
        d = centre[:used] - p[i]
        bad = np.nonzero((d * d).sum(1) < radius[:used] * (1 + 1e-12))[0]
        t = tri[bad]
        sides = np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]])
        key = np.minimum(sides[:, 0], sides[:, 1]) * (n + 3) + np.maximum(sides[:, 0], sides[:, 1])
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        rim = sides[first[times == 1]]
        radius[bad] = -1.0
        free.extend(bad.tolist())
        while len(free) < len(rim):
            free.append(used)
            used += 1
        slots = np.array([free.pop() for _ in range(len(rim))], dtype=np.int64)
        if len(slots) and slots.max() >= len(tri):
            more = len(tri)
            tri, centre, radius = np.vstack([tri, np.full((more, 3), -1)]), np.vstack([centre, np.zeros((more, 2))]), np.append(radius, np.full(more, -1.0))
        tri[slots] = np.column_stack([rim, np.full(len(rim), i)])
        centre[slots], radius[slots] = circumcircles(p, tri[slots])
    kept = tri[:used][radius[:used] >= 0]
    return kept[(kept < n).all(1)]


#: Points at the rim of what is covered that one task triangulates; more of them go through wider tiles first.
RIM_POINTS = 10_000


def _tiled(points: DataFrame, halo: float | None, tile: float) -> DataFrame:
    """a < b < c (keys), ring, longest of the triangles of ``_k``, ``_x``, ``_y`` with a circle up to ``halo``; with None all, in one tile."""
    kind = points.schema["_k"].dataType.simpleString()
    if halo is None:
        spread = points.withColumn("_ti", F.lit(0)).withColumn("_tj", F.lit(0))
    else:
        # A circle around a centre in the tile reaches `halo` beyond it, and so do the points that could lie in it.
        reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
        spread = points.withColumn("_ti", F.explode(reach("_x"))).withColumn("_tj", F.explode(reach("_y")))

    def run(tile_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        pts, ids = pdf[["_x", "_y"]].to_numpy(float), pdf["_k"].to_numpy()
        tri = triangulate(pts)
        if len(tri):
            centre, r2 = circumcircles(pts, tri)
            tri = tri[np.isfinite(r2) if halo is None else (np.floor(centre / tile) == np.array(tile_key, float)).all(1) & (r2 <= halo * halo)]
        tri = np.sort(tri, axis=1)  # points come in the order of their keys
        corners = pts[tri]
        length = np.sqrt(((corners - np.roll(corners, 1, axis=1)) ** 2).sum(2)).max(1) if len(tri) else np.zeros(0)
        rings = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in corners]
        return pd.DataFrame({"a": ids[tri[:, 0]], "b": ids[tri[:, 1]], "c": ids[tri[:, 2]], "ring": pd.Series(rings, dtype=object), "longest": pd.Series(length, dtype=float)})

    schema = f"a {kind}, b {kind}, c {kind}, ring array<struct<x:double,y:double>>, longest double"
    return spread.groupBy("_ti", "_tj").applyInPandas(run, schema)


def _sides(triangles: DataFrame) -> DataFrame:
    pair = lambda s, d: F.struct(F.col(s).alias("s"), F.col(d).alias("d"))
    return triangles.select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("_e")).select("_e.s", "_e.d")


def delaunay(cells: DataFrame, *, key: str = "cell_id", halo: float = 100.0, tile: float = 400.0, rim_points: int = RIM_POINTS) -> DataFrame:
    """a < b < c (keys), ring, longest: the Delaunay triangles of all cells.

    Cells at one position count as the one of least key; null or non-finite positions take no part. Slivers along the
    hull whose circle is wider than about thirty times the section are left out. The last of the rounds over the rim
    takes one task, with at most ``rim_points`` points or those of a tile as wide as the section.
    """
    ship_package(cells.sparkSession)
    p = cells.select(F.col(key).alias("_k"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).where(finite(F.col("_x"), F.col("_y")))
    p = materialize(p.groupBy("_x", "_y").agg(F.min("_k").alias("_k")), "centres")
    box = p.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    size = 0.0 if box[0] is None else max(box[1] - box[0], box[3] - box[2])
    found = materialize(_tiled(p, halo, tile), "triangles")
    new, rim, loose = found, None, p
    while True:
        sides = _sides(new) if rim is None else _sides(new).unionByName(rim)
        rim = materialize(sides.groupBy("s", "d").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select("s", "d"), "rim")
        loose = materialize(loose.join(new.select(F.explode(F.array("a", "b", "c")).alias("_k")).distinct(), "_k", "left_anti"), "loose")
        ends = rim.select(F.explode(F.array("s", "d")).alias("_k")).distinct()
        points = materialize(p.join(ends.unionByName(loose.select("_k")), "_k"), "rim-points")
        halo, tile = 4 * halo, 4 * tile
        last = points.count() <= rim_points or halo >= size
        # Edges of triangles found are edges of the rim's own triangulation, so each of its triangles lies within what is covered or outside of it.
        more = materialize(_tiled(points, None if last else halo, tile).withColumn("tid", F.monotonically_increasing_id()), "more")
        middle = lambda c: (F.get("ring", F.lit(0))[c] + F.get("ring", F.lit(1))[c] + F.get("ring", F.lit(2))[c]) / 3
        covered = points_in_rings(more.select("tid", middle("x").alias("x"), middle("y").alias("y")), found.withColumn("_t", F.concat_ws("-", "a", "b", "c")), point_key="tid", ring_key="_t")
        new = materialize(more.join(covered.select("tid").distinct(), "tid", "left_anti").drop("tid"), "triangles")
        found = materialize(found.unionByName(new), "triangles")
        if last:
            return found


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """src, dst in both directions, each pair of joined cells once."""
    e = _sides(triangles).distinct()
    return e.select(F.col("s").alias("src"), F.col("d").alias("dst")).unionByName(e.select(F.col("d").alias("src"), F.col("s").alias("dst")))


def void_clusters(triangles: DataFrame, *, share: float = 0.75, least: int = 30) -> DataFrame:
    """triangles with ``tid``, ``cluster`` and ``n_triangles``: neighbours across long edges form voids.

    The limit of a long edge is the ``share`` quantile of the lengths of the edges that two triangles share. Clusters of fewer
    than ``least`` triangles have the cluster -1 and count as 1.
    """
    names = F.concat_ws("-", "a", "b", "c")
    t = materialize(triangles.withColumn("tid", F.xxhash64(names)), "triangles")
    v = lambda i: F.get("ring", F.lit(i))
    length = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    side = lambda s, d, i, j: F.struct(F.col(s).alias("s"), F.col(d).alias("d"), length(v(i), v(j)).alias("len"))
    sides = t.select("tid", F.explode(F.array(side("a", "b", 0, 1), side("b", "c", 1, 2), side("a", "c", 0, 2))).alias("_s")).select("tid", "_s.s", "_s.d", "_s.len")
    shared = sides.groupBy("s", "d").agg(F.count(F.lit(1)).alias("_n"), F.min("len").alias("len")).where(F.col("_n") == 2)
    limit = shared.agg(F.percentile("len", F.lit(share)).alias("_t"))
    long = T.one_row(sides, limit).where(F.col("len") >= F.col("_t")).groupBy("s", "d").agg(F.min("tid").alias("src"), F.max("tid").alias("dst"))
    comp = components(t.select("tid"), long.where(F.col("src") < F.col("dst")).select("src", "dst"), key="tid")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    big = F.col("_n") >= least
    marked = comp.join(sizes, "component").select("tid", F.when(big, F.col("component")).otherwise(F.lit(-1)).alias("cluster"), F.when(big, F.col("_n")).otherwise(F.lit(1)).alias("n_triangles"))
    return t.join(marked, "tid")


def void_counts(voids: DataFrame, points: DataFrame, *, point_key: str, flag: str | None = None) -> DataFrame:
    """tid, n and, with ``flag``, n_flagged: points in each triangle; 0 included."""
    src = points if flag is None else points.select(point_key, "x", "y", flag)
    hits = points_in_rings(src, voids, point_key=point_key, ring_key="tid")
    aggs = [F.count(F.lit(1)).alias("n")]
    if flag is not None:
        hits = hits.join(points.select(point_key, flag), point_key)
        aggs.append(F.count_if(F.col(flag)).alias("n_flagged"))
    counts = hits.groupBy("tid").agg(*aggs)
    return voids.select("tid").join(counts, "tid", "left").fillna(0)


def incident_sums(voids: DataFrame, counts: DataFrame, cells: DataFrame, *, key: str = "cell_id") -> DataFrame:
    """key, outside: sum of the counts of the triangles each cell is a corner of; 0 included."""
    corners = voids.select("tid", F.explode(F.array("a", "b", "c")).alias(key)).join(counts.select("tid", "n"), "tid")
    return cells.select(key).distinct().join(corners.groupBy(key).agg(F.sum("n").alias("outside")), key, "left").fillna(0, ["outside"])


def cluster_sums(voids: DataFrame, counts: DataFrame) -> DataFrame:
    """cluster, triangles, molecules, log_molecules over the voids that are clusters."""
    s = voids.where(F.col("cluster") != -1).join(counts, "tid").groupBy("cluster").agg(F.count(F.lit(1)).alias("triangles"), F.sum("n").alias("molecules"))
    return s.withColumn("log_molecules", F.log10(F.col("molecules") + 1))
