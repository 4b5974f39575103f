"""Connected regions of pixels and their bounding boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histolith.operators.graphs import components
from histolith.operators.raster import TILE
from histolith.session import materialize, ship_package


def label_runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """8-connected labels of distinct pixels by union-find over runs; a label is the place of its first pixel."""
    order = np.lexsort((x, y))
    xs, ys = x[order], y[order]
    new = np.ones(len(xs), bool)
    new[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    run = np.cumsum(new) - 1
    start, stop = np.nonzero(new)[0], np.append(np.nonzero(new)[0][1:], len(xs)) - 1
    lo, hi, row = xs[start], xs[stop], ys[start]
    parent = np.arange(len(start))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    j = 0
    for i in range(len(start)):
        while j < i and (row[j] < row[i] - 1 or (row[j] == row[i] - 1 and hi[j] < lo[i] - 1)):
            j += 1
        k = j
        while k < i and row[k] == row[i] - 1 and lo[k] <= hi[i] + 1:
            a, b = find(k), find(i)
            parent[max(a, b)] = min(a, b)
            k += 1
    roots = np.array([find(i) for i in range(len(start))], dtype=np.int64)
    out = np.empty(len(xs), np.int64)
    out[order] = order[start[roots[run]]]
    return out


def connected_regions(pixels: DataFrame, *, tile: int = TILE) -> DataFrame:
    """px, py, region: 8-connected regions; a region's name is the least (py, px) code of one of its pixels.

    Tiles are labelled on their own with one pixel of overlap; a pixel that two tiles name differently joins
    their labels, and those few joins are closed by components over labels, not over pixels.
    """
    ship_package(pixels.sparkSession)
    code = F.shiftleft(F.col("py").cast("long") + F.lit(1 << 30), 31) + F.col("px").cast("long") + F.lit(1 << 30)
    reach = lambda c: F.sequence(F.floor((F.col(c) - 1) / tile).cast("int"), F.floor(F.col(c) / tile).cast("int"))
    spread = pixels.select("px", "py").distinct().withColumn("code", code).withColumn("_ti", F.explode(reach("px"))).withColumn("_tj", F.explode(reach("py")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code", ignore_index=True)
        first = label_runs(pdf["px"].to_numpy(np.int64), pdf["py"].to_numpy(np.int64))
        least = pd.Series(pdf["code"]).groupby(first).transform("min")
        own = (pdf["px"] // tile == key[0]) & (pdf["py"] // tile == key[1])
        return pd.DataFrame({"px": pdf["px"], "py": pdf["py"], "code": pdf["code"], "label": least, "own": own})

    tiles = materialize(spread.groupBy("_ti", "_tj").applyInPandas(run, "px int, py int, code long, label long, own boolean"), "regions")
    ties = tiles.groupBy("code").agg(F.min("label").alias("src"), F.max("label").alias("dst"), F.min(F.when(F.col("own"), F.col("label"))).alias("mid")).where(F.col("src") < F.col("dst"))
    edges = ties.select("src", "dst").unionByName(ties.select("src", F.col("mid").alias("dst"))).distinct()
    names = components(tiles.select("label"), edges, key="label")
    return tiles.where("own").join(names, "label").select("px", "py", F.col("component").alias("region"))


def bounding_boxes(regions: DataFrame, *, least_area: int = 100_000) -> DataFrame:
    """region, x0, y0, x1, y1 (ends excluded), area of the boxes with more than ``least_area`` pixels."""
    b = regions.groupBy("region").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), (F.max("px") + 1).alias("x1"), (F.max("py") + 1).alias("y1"))
    return b.withColumn("area", (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))).where(F.col("area") > least_area)


def merge_boxes(boxes: DataFrame, *, most: int = 100_000) -> DataFrame:
    """x0, y0, x1, y1 after overlapping boxes were replaced by their union until none overlap; edges that touch do not.

    Boxes are few, as each is of a large region; more than ``most`` are an error.
    """
    rows = boxes.select("x0", "y0", "x1", "y1").orderBy("x0", "y0", "x1", "y1").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} boxes")
    todo, done = [list(r) for r in rows], []
    while todo:
        box = todo.pop()
        hit = [b for b in todo + done if b[0] < box[2] and box[0] < b[2] and b[1] < box[3] and box[1] < b[3]]
        if hit:
            todo, done = [b for b in todo if b not in hit], [b for b in done if b not in hit]
            group = [box, *hit]
            todo.append([min(b[0] for b in group), min(b[1] for b in group), max(b[2] for b in group), max(b[3] for b in group)])
        else:
            done.append(box)
    return boxes.sparkSession.createDataFrame([tuple(b) for b in sorted(done)], "x0 int, y0 int, x1 int, y1 int")
