"""Local autocorrelation of gene counts in the neighbourhood of each cell, and its transfer to molecules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histolith.operators.graphs import nearest
from histolith.operators.proximity import finite
from histolith.session import ship_package


def neighbourhood_moran(pos: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Moran's I of each column over the k nearest neighbours within one neighbourhood; NaN without variance."""
    n = len(pos)
    k = min(k, n - 1)
    gap = ((pos[:, None] - pos[None]) ** 2).sum(-1)
    np.fill_diagonal(gap, np.inf)
    near = np.argpartition(gap, k - 1, axis=1)[:, :k]
    z = counts - counts.mean(0)
    lag = z[near].mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((z * z).sum(0) > 1e-12, (z * lag).sum(0) / (z * z).sum(0), np.nan)


def local_moran(cells: DataFrame, expr: DataFrame, *, radius: float = 100.0, more_than: int = 30, k: int = 30, tile: float = 200.0) -> DataFrame:
    """cell_id, gene, morans_i of every gene a cell expresses; null for small neighbourhoods or genes without variance.

    The neighbourhood are the other cells within the radius. Cells go to their tile and, within the radius, to its
    neighbours; counts travel as one array per cell, so the shuffle holds each cell a few times and never a pair.
    """
    ship_package(cells.sparkSession)
    kind = cells.schema["cell_id"].dataType.simpleString()
    arrays = expr.groupBy("cell_id").agg(F.collect_list("gene").alias("_g"), F.collect_list(F.col("n").cast("double")).alias("_n"))
    p = cells.select("cell_id", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).where(finite(F.col("_x"), F.col("_y"))).dropDuplicates(["cell_id"])
    reach = lambda c: F.sequence(F.floor((F.col(c) - radius) / tile).cast("int"), F.floor((F.col(c) + radius) / tile).cast("int"))
    spread = p.join(arrays, "cell_id", "left").withColumn("_ti", F.explode(reach("_x"))).withColumn("_tj", F.explode(reach("_y")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", ignore_index=True)
        pos = pdf[["_x", "_y"]].to_numpy(float)
        lists = [list(g) if g is not None else [] for g in pdf["_g"]]
        names = sorted({g for row in lists for g in row})
        place = {g: i for i, g in enumerate(names)}
        dense = np.zeros((len(pdf), len(names)))
        for i, (g, n) in enumerate(zip(lists, pdf["_n"])):
            if g:
                dense[i, [place[x] for x in g]] = list(n)
        own = np.nonzero((np.floor(pos / tile) == np.array(key, float)).all(1))[0]
        ids, out = pdf["cell_id"].to_numpy(), []
        for i in own:
            if not lists[i]:
                continue
            d2 = ((pos - pos[i]) ** 2).sum(1)
            hood = np.nonzero(d2 <= radius * radius)[0]
            hood = hood[hood != i]
            cols = [place[x] for x in lists[i]]
            score = neighbourhood_moran(pos[hood], dense[np.ix_(hood, cols)], k) if len(hood) > more_than else np.full(len(cols), np.nan)
            out.append(pd.DataFrame({"cell_id": ids[i], "gene": lists[i], "morans_i": score}))
        return pd.concat(out) if out else pd.DataFrame({"cell_id": ids[:0], "gene": np.array([], object), "morans_i": np.array([], float)})

    rows = spread.groupBy("_ti", "_tj").applyInPandas(run, f"cell_id {kind}, gene string, morans_i double")
    return rows.withColumn("morans_i", F.nanvl("morans_i", F.lit(None).cast("double")))


def molecule_scores(molecules: DataFrame, local: DataFrame, *, within: float = 100.0) -> DataFrame:
    """transcript_id, score: the local value of its cell and gene; for molecules without one that of the nearest
    molecule of the same gene that has one, less than ``within`` away, and 0 without any."""
    own = molecules.join(local, ["cell_id", "gene"], "left").select("transcript_id", "gene", "x", "y", "morans_i")
    have, lack = own.where(F.col("morans_i").isNotNull()), own.where(F.col("morans_i").isNull())
    sources = have.select(F.col("transcript_id").alias("_source"), "gene", "x", "y")
    near = nearest(lack, sources, query_key="transcript_id", point_key="_source", by="gene", within=within)
    borrowed = near.join(have.select(F.col("transcript_id").alias("_source"), "morans_i"), "_source").select("transcript_id", F.col("morans_i").alias("_borrowed"))
    return own.join(borrowed, "transcript_id", "left").select("transcript_id", F.coalesce("morans_i", "_borrowed", F.lit(0.0)).alias("score"))
