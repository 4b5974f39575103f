"""Expression models: normalisation, variable genes, scores, phases, components, clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histolith.operators import tabular as T


def normalise(expr: DataFrame, value: str = "n") -> DataFrame:
    """expr with ``normlog``: log1p of counts scaled so that every cell has the median cell's total."""
    totals = expr.groupBy("cell_id").agg(F.sum(value).alias("_total"))
    target = totals.agg(F.median("_total").alias("_target"))
    return T.one_row(expr.join(totals, "cell_id"), target).withColumn("normlog", F.log1p(F.col(value) * F.col("_target") / F.col("_total"))).drop("_total", "_target")


def scale(expr: DataFrame, n_cells: int, value: str = "normlog") -> DataFrame:
    """gene statistics over all cells, implicit zeros included: gene, mean, sd, zero_score, and ``z`` of each non-zero."""
    s = expr.groupBy("gene").agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss"))
    mean = F.col("_s") / n_cells
    var = (F.col("_ss") - n_cells * mean * mean) / F.lit(max(n_cells - 1, 1))
    g = s.select("gene", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))
    return expr.join(g, "gene").withColumn("z", T.share(F.col(value) - F.col("mean"), F.col("sd")))


def variable_genes(expr: DataFrame, n_cells: int, top: int = 200, bins: int = 20, value: str = "n") -> DataFrame:
    """gene, dispersion, rank of the ``top`` genes of greatest dispersion, standardised within bins of equal mean rank."""
    s = expr.groupBy("gene").agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss"))
    mean = F.col("_s") / n_cells
    var = F.col("_ss") / n_cells - mean * mean
    g = s.select("gene", mean.alias("mean"), F.ln(F.greatest(T.share(var, mean), F.lit(1e-12))).alias("d"))
    g = g.withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))  # genes, not cells
    b = Window.partitionBy("bin")
    g = g.withColumn("dispersion", F.coalesce(T.share(F.col("d") - F.avg("d").over(b), F.stddev("d").over(b)), F.lit(0.0)))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.col("dispersion").desc(), "gene"))).where(F.col("rank") <= top).select("gene", "dispersion", "rank")


def gene_set_score(expr: DataFrame, cells: DataFrame, gene_set: DataFrame, *, bins: int = 25, controls: int = 50, value: str = "n", salt: str = "score") -> DataFrame:
    """cell_id, score: mean of the set's genes minus mean of control genes of the same expression bins.

    Controls are chosen by the hash of their name, up to ``controls`` per bin that holds a gene of the set; zeros count.
    """
    means = expr.groupBy("gene").agg(F.sum(value).alias("_s"))
    means = means.withColumn("bin", F.ntile(bins).over(Window.orderBy("_s", "gene")))
    chosen = means.join(gene_set.select("gene").distinct(), "gene", "left_semi")
    pool = means.join(chosen.select("bin").distinct(), "bin", "left_semi").join(chosen.select("gene"), "gene", "left_anti")
    order = Window.partitionBy("bin").orderBy(F.xxhash64(F.lit(salt), "gene"), "gene")
    control = pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= controls).select("gene", F.lit(-1).alias("side"))
    used = chosen.select("gene", F.lit(1).alias("side")).unionByName(control)
    sizes = used.agg(F.count_if(F.col("side") > 0).alias("_n1"), F.count_if(F.col("side") < 0).alias("_n0"))
    sums = expr.join(F.broadcast(used), "gene").groupBy("cell_id").agg(F.sum(F.when(F.col("side") > 0, F.col(value)).otherwise(0)).alias("_a"), F.sum(F.when(F.col("side") < 0, F.col(value)).otherwise(0)).alias("_b"))
    all_cells = T.one_row(cells.select("cell_id").distinct().join(sums, "cell_id", "left").fillna(0, ["_a", "_b"]), sizes)
    part = lambda a, n: F.coalesce(T.share(F.col(a), F.col(n)), F.lit(0.0))
    return all_cells.select("cell_id", (part("_a", "_n1") - part("_b", "_n0")).alias("score"))


def cell_cycle_phase(expr: DataFrame, cells: DataFrame, s_genes: DataFrame, g2m_genes: DataFrame, value: str = "n") -> DataFrame:
    """cell_id, s_score, g2m_score, phase: G1 where neither score is positive, else that of the greater one."""
    s = gene_set_score(expr, cells, s_genes, value=value, salt="S").withColumnRenamed("score", "s_score")
    g = gene_set_score(expr, cells, g2m_genes, value=value, salt="G2M").withColumnRenamed("score", "g2m_score")
    phase = F.when((F.col("s_score") <= 0) & (F.col("g2m_score") <= 0), "G1").when(F.col("g2m_score") > F.col("s_score"), "G2M").otherwise("S")
    return s.join(g, "cell_id").withColumn("phase", phase)


def gene_vectors(expr: DataFrame, cells: DataFrame, genes: list[str], value: str = "normlog") -> DataFrame:
    """cell_id, features: one dense vector per cell over a list of panel genes."""
    wide = expr.where(F.col("gene").isin(genes)).groupBy("cell_id").pivot("gene", genes).agg(F.sum(value))
    rows = cells.select("cell_id").distinct().join(wide, "cell_id", "left").fillna(0.0)
    return rows.select("cell_id", array_to_vector(F.array(*[F.col(f"`{g}`").cast("double") for g in genes])).alias("features"))


def principal_components(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """cell_id, pcs array<double>, and the explained share of variance of each component."""
    model = PCA(k=k, inputCol="features", outputCol="_pcs").fit(vectors)
    return model.transform(vectors).select("cell_id", vector_to_array("_pcs").alias("pcs")), [float(v) for v in model.explainedVariance]


def assemble(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df).select(*keep, "features")


def kmeans(vectors: DataFrame, k: int, keep: list[str], seed: int = 123) -> DataFrame:
    """keep columns and ``cluster`` from 0."""
    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors)
    return model.transform(vectors).select(*keep, F.col("prediction").alias("cluster"))


def resolution_search(vectors: DataFrame, sizes: list[int], seeds: list[int], target: int) -> DataFrame:
    """k, seed, silhouette of every trial, the best of the size closest to ``target`` flagged."""
    rows = []
    for k in sizes:
        for seed in seeds:
            fitted = KMeans(k=k, seed=seed, maxIter=10).fit(vectors).transform(vectors)
            rows.append((k, seed, float(ClusteringEvaluator().evaluate(fitted)), abs(k - target)))
    out = vectors.sparkSession.createDataFrame(rows, "k int, seed int, silhouette double, off int")
    best = Window.orderBy("off", F.col("silhouette").desc(), "seed")  # one row per trial
    return out.withColumn("chosen", F.row_number().over(best) == 1).drop("off")


def cluster_scores(pixels: DataFrame, cluster: str, structure: list[str], anti: list[str]) -> DataFrame:
    """cluster, s_score, as_score, cluster_score: mean structure minus mean anti-structure, rounded to 2 digits."""
    total = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    means = pixels.groupBy(cluster).agg(F.avg(total(structure)).alias("s_score"), F.avg(total(anti)).alias("as_score"))
    return means.withColumn("cluster_score", F.bround(F.col("s_score") - F.col("as_score"), 2))


def positive(col: Column) -> Column:
    return (col > 0.5).cast("int")
