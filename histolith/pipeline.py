"""Quality control of a tissue section, step by step: the engine's verbs.

Each step takes a ``Section`` and returns DataFrames; nothing is kept between steps but what the caller passes on or
stores in a ``MetricStore``. ``python -m histolith.pipeline IN OUT STEP...`` writes each step's tables as Parquet.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.operators import delaunay, geometry, graphs, local_moran, mrf, priors, raster, regions
from histolith.operators import models as M
from histolith.operators import tabular as T
from histolith.operators.proximity import points_within
from histolith.session import materialize, remove_stages, spread, table
from histolith.sources import bundle as B
from histolith.sources.files import MetricStore

BELIEF_LIMIT = 0.45
CLASS_PIXELS = 15


@dataclass
class Section:
    """A bundle folder and the tables that steps share."""

    spark: SparkSession
    path: str
    results: dict = field(default_factory=dict)

    def result(self, step: str) -> DataFrame | dict[str, DataFrame]:
        """What a step gives, worked out once."""
        if step not in self.results:
            self.results[step] = STEPS[step](self)
        return self.results[step]

    @cached_property
    def molecules(self) -> DataFrame:
        return materialize(B.transcripts(self.spark, self.path), "molecules")

    @cached_property
    def cells(self) -> DataFrame:
        return materialize(B.cells(self.spark, self.path), "cells")

    @cached_property
    def expression(self) -> DataFrame:
        return materialize(B.expression(self.molecules), "expression")

    @cached_property
    def rings(self) -> DataFrame:
        return B.rings(self.spark, self.path)

    @cached_property
    def genes(self) -> DataFrame:
        return B.genes(self.spark, self.path)

    @cached_property
    def doublets(self) -> DataFrame:
        return table(self.spark, self.path, "doublet_df")

    @cached_property
    def extent(self) -> raster.Extent:
        return raster.Extent.of(self.molecules)


def annotate(s: Section) -> DataFrame:
    return s.cells.join(B.annotation(s.spark, s.path), "cell_id", "left")


def general_qc(s: Section) -> DataFrame:
    """Per cell: counts, genes, shares of gene classes, counts by area, validity of the ring."""
    qc = T.cell_qc(s.expression, s.genes)
    valid = geometry.repair_rings(table(s.spark, s.path, "cell_boundaries"), "cell_id").groupBy("cell_id").agg(F.bool_and("valid").alias("valid_ring"))
    c = s.cells.select("cell_id", "cell_area").join(qc, "cell_id", "left").join(valid, "cell_id", "left")
    per_area = lambda n: T.share(F.col(n), F.col("cell_area")).alias(f"canorm_{n}")
    return c.select("*", per_area("total_counts"), per_area("n_genes"), F.log10(F.coalesce("total_counts", F.lit(0)) + 1).alias("log_total_counts")).drop("cell_area")


def bubble(s: Section) -> DataFrame:
    ring = F.col("ring")
    r = s.rings.select("cell_id", geometry.area(ring).alias("area"), geometry.perimeter(ring).alias("perimeter"), geometry.thinness(ring).alias("thinness"))
    r = T.one_row(r, r.agg(F.percentile("area", F.lit(0.9)).alias("_q")))
    return r.withColumn("bubble", (F.col("area") > F.col("_q")) & (F.col("thinness") > 0.1)).drop("_q")


def doublets(s: Section) -> DataFrame:
    """Per cell: distance to the nearest doublet (null without any), flag, and area shared with other cells."""
    near = graphs.nearest(s.cells, s.doublets, query_key="cell_id", point_key="doublet_id", within=100_000.0, first=10.0)
    shared = geometry.overlap_area(s.rings, "cell_id")
    out = s.cells.select("cell_id").join(near.select("cell_id", F.col("distance").alias("doublet_distance")), "cell_id", "left").join(shared, "cell_id", "left")
    return out.withColumn("doublet", F.coalesce(F.col("doublet_distance") <= 10, F.lit(False)))


def doublet_molecules(s: Section) -> DataFrame:
    near = points_within(s.molecules, s.doublets, 10.0, query_key="transcript_id", point_key="doublet_id").select("transcript_id").distinct()
    return s.molecules.select("transcript_id").join(near.withColumn("doublet", F.lit(True)), "transcript_id", "left").fillna(False, ["doublet"])


def voids(s: Section) -> dict[str, DataFrame]:
    v = materialize(delaunay.void_clusters(delaunay.delaunay(s.cells)), "voids")
    counts = materialize(delaunay.void_counts(v, s.molecules.where(F.col("cell_id") == B.NO_CELL), point_key="transcript_id"), "void-counts")
    return {"voids": v, "void_counts": counts, "void_sums": delaunay.cluster_sums(v, counts), "outside": delaunay.incident_sums(v, counts, s.cells)}


def cell_qc(s: Section) -> DataFrame:
    """Per cell: convexity, border and island scores, molecules of low quality."""
    convex = s.rings.groupBy("cell_id").agg(F.max(geometry.convexity(F.col("ring"))).alias("convexity"))
    low = s.molecules.where((F.col("qv") < 20) & (F.col("cell_id") != B.NO_CELL)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("low_qv"))
    out = s.cells.select("cell_id").join(convex, "cell_id", "left").join(graphs.border_scores(s.cells), "cell_id", "left")
    return out.join(graphs.islands(s.cells), "cell_id", "left").join(low, "cell_id", "left").fillna(0, ["low_qv"])


def _cell_prior(s: Section, flagged: DataFrame, flag: str) -> DataFrame:
    near = graphs.nearest(s.cells, s.doublets, query_key="cell_id", point_key="doublet_id", within=100_000.0, first=10.0)
    doublet = priors.distance_prior(s.cells.select("cell_id").join(near, "cell_id", "left"), "distance", "p_doublet").select("cell_id", "p_doublet")
    return priors.combine(priors.good_neighbour_prior(flagged, flag).join(doublet, "cell_id"), ["p_good", "p_doublet"], "p")


#: A cell is a doublet with one nearer than this.
DOUBLET_REACH = 10.0


def hqcr(s: Section, celltype: bool = False) -> dict[str, DataFrame]:
    """Beliefs of the cell layer: prior per cell, drawn to pixels, smoothed, and brought back to cells."""
    if celltype:
        near = graphs.nearest(s.cells, s.doublets, query_key="cell_id", point_key="doublet_id", within=DOUBLET_REACH).select("cell_id", F.lit(True).alias("_near"))
        free = F.coalesce("nucleus_area", F.lit(0.0)) == 0
        kind = F.when(F.coalesce("_near", F.lit(False)), "doublet").when(free, "nucleus_free").otherwise("none")
        c = materialize(s.cells.join(near, "cell_id", "left").withColumn("artefact", kind).drop("_near"), "artefacts")
        flagged, flag = priors.outside_bounds(c, priors.celltype_bounds(c, ["transcript_counts"]), "transcript_counts"), "outside"
    else:
        flagged, flag = priors.bad_cluster_flags(s.cells, "leiden", "transcript_counts"), "bad"
    prior = materialize(_cell_prior(s, flagged, flag), "cell-prior")
    owned = materialize(raster.rasterise(spread(s.rings), ["cell_id"]), "owned-pixels")
    pixels = owned.join(prior.select("cell_id", "p"), "cell_id").groupBy("px", "py").agg(F.avg("p").alias("p"))
    smoothed = materialize(mrf.smooth(pixels, "p", s.extent), "hqcr")
    return {"hqcr_cells": to_cells(owned, smoothed), "hqcr_pixels": smoothed, "hqcr_prior": prior}


def to_cells(owned: DataFrame, pixels: DataFrame) -> DataFrame:
    """cell_id, class (more than 15 labelled pixels), belief and its mean over non-zero pixels, filtered_out."""
    p = owned.join(pixels, ["px", "py"]).groupBy("cell_id")
    nonzero = F.coalesce(F.avg(F.when(F.col("belief") != 0, F.col("belief"))), F.lit(0.0))
    out = p.agg((F.sum("label") > CLASS_PIXELS).alias("class"), F.avg("belief").alias("belief"), nonzero.alias("belief_nonzero"))
    return out.withColumn("filtered_out", F.col("belief") < BELIEF_LIMIT)


def texture_prior(s: Section, pixels: DataFrame, value: str, clusters: int = 100) -> dict[str, DataFrame]:
    """Structure of a picture: texture metrics, clusters of pixels and their scores, and the prior p_structure of each pixel."""
    ex = s.extent
    metric = lambda name: raster.pixel_metric(pixels, value, ex, name)
    m = materialize(metric("texture").join(metric("energy"), ["px", "py"]).join(metric("edge"), ["px", "py"]).join(metric("blur"), ["px", "py"]), "textures")
    m = T.one_row(m, raster.otsu_threshold(m, "blur")).withColumn("relevance", (F.col("blur") > F.col("threshold")).cast("double")).drop("threshold")
    features = ["entropy", "homogeneity", "uniformity", "energy", "edge", "relevance"]
    clustered = materialize(M.kmeans(M.assemble(m, features, ["px", "py", *features]), clusters, ["px", "py", *features]), "pixel-clusters")
    scores = M.cluster_scores(clustered, "cluster", ["edge", "energy", "relevance", "entropy"], ["homogeneity", "uniformity"])
    prior = priors.pixel_prior(scores, "cluster_score", "p_informative")
    # One row per cluster of pixels, of which there are `clusters`.
    probability = T.min_max(clustered.select("px", "py", "cluster").join(F.broadcast(prior.select("cluster", "p_informative")), "cluster"), "p_informative", "p_structure")
    return {"metrics": m, "clusters": scores, "prior": materialize(probability.select("px", "py", "p_structure"), "structure")}


def smoothed_layer(s: Section, probability: DataFrame) -> dict[str, DataFrame]:
    """Beliefs of pixels after belief propagation, and the boxes around their connected regions."""
    smoothed = materialize(mrf.smooth(probability, "p", s.extent), "layer")
    found = regions.connected_regions(smoothed.where(F.col("label") == 1).select("px", "py"))
    return {"pixels": smoothed, "boxes": regions.bounding_boxes(found)}


def hqtr(s: Section, clusters: int = 100) -> dict[str, DataFrame]:
    """Beliefs of the molecule layer: structure of the density picture, quality of the molecules, and what is not ambient."""
    n = s.molecules.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    density = materialize(raster.stencil(n, "n", s.extent, raster.disk(3), target="v"), "density")
    structure = texture_prior(s, density, "v", clusters)
    scored = s.molecules.join(ambient(s).select("gene", "morans_i"), "gene", "left").join(local_ambient(s), "transcript_id", "left")
    scored = materialize(scored.select("px", "py", "qv", "morans_i", "score"), "scored-molecules")
    prior = priors.molecule_priors(structure.pop("prior"), raster.quality_density(scored, s.extent), raster.ambient_density(scored, ("morans_i", "score"), s.extent))
    prior = materialize(prior, "molecule-prior")
    return {**structure, "priors": prior, **smoothed_layer(s, prior.select("px", "py", "p"))}


def hqpr(s: Section, stain: DataFrame | None = None, clusters: int = 100) -> dict[str, DataFrame]:
    """Beliefs of the image layer, from the pixels (px, py, v) of one stain channel, by default the table ``stain`` of the bundle."""
    structure = texture_prior(s, table(s.spark, s.path, "stain") if stain is None else stain, "v", clusters)
    return {**structure, **smoothed_layer(s, structure.pop("prior").select("px", "py", F.col("p_structure").alias("p")))}


def ambient(s: Section) -> DataFrame:
    """Moran's I of every gene over the Delaunay neighbours of the cells."""
    edges = materialize(delaunay.triangle_edges(delaunay.delaunay(s.cells)), "edges")
    return graphs.moran(s.expression, edges, s.cells)


def local_ambient(s: Section) -> DataFrame:
    return local_moran.molecule_scores(s.molecules.where(F.col("gene") != B.NO_GENE), materialize(local_moran.local_moran(s.cells, s.expression), "local"))


def combine(layers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Mean belief and number of layers per pixel, and the shares of the three masks' regions, of layers (px, py, belief, label)."""
    joined = None
    for name, df in layers.items():
        part = df.select("px", "py", F.col("belief").alias(f"{name}_belief"), F.col("label").alias(f"{name}_label"))
        joined = part if joined is None else joined.join(part, ["px", "py"], "full")
    assert joined is not None
    total = lambda kind: sum((F.coalesce(F.col(f"{n}_{kind}"), F.lit(0)) for n in layers), F.lit(0))
    pixels = joined.withColumn("mean_belief", total("belief") / len(layers)).withColumn("mask_sum", total("label"))
    out = {"pixels": pixels}
    if len(layers) == 3:
        a, b, c = (f"{n}_label" for n in layers)
        out["regions"] = T.three_set_venn(pixels.fillna(0, [a, b, c]), a, b, c)
    return out


def molecule_qc(s: Section) -> DataFrame:
    """Molecules by gene class and place."""
    place = F.when(F.col("cell_id") == B.NO_CELL, "outside").when(F.col("overlaps_nucleus") == 1, "nucleus").otherwise("cytoplasm")
    kind = F.when(F.col("gene").rlike("^NegControlCodeword"), "negative control").otherwise("gene")
    return s.molecules.groupBy(place.alias("location"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("qv").alias("mean_qv"))


def summary(s: Section, metrics: list[DataFrame]) -> DataFrame:
    """Median of every metric per cluster."""
    c = s.cells.select("cell_id", "leiden")
    for m in metrics:
        c = c.join(m, "cell_id", "left")
    numbers = [n for n, t in c.dtypes if t in ("double", "bigint", "int", "float") and n != "cell_id"]
    return c.groupBy("leiden").agg(*[F.median(n).alias(n) for n in numbers])


def combined(s: Section) -> dict[str, DataFrame]:
    """Layers of cells, cells within their types and molecules combined, and for each cell the layers that leave it out."""
    cell, refined, molecule = (s.result(n) for n in ("hqcr_ident", "hqcr_celltype", "hqtr"))
    layers = {"hqcr": cell["hqcr_pixels"], "refined": refined["hqcr_pixels"], "hqtr": molecule["pixels"]}
    owned = materialize(raster.rasterise(spread(s.rings), ["cell_id"]), "owned-pixels")
    kept = s.cells.select("cell_id")
    for name, pixels in layers.items():
        kept = kept.join(to_cells(owned, pixels).select("cell_id", F.col("belief").alias(f"{name}_belief"), F.col("filtered_out").alias(f"{name}_filtered_out")), "cell_id", "left")
    out = [F.coalesce(F.col(f"{name}_filtered_out"), F.lit(False)) for name in layers]
    return {**combine(layers), "cells": kept.withColumn("filtered", out[0] | out[1] | out[2])}


def summarised(s: Section) -> DataFrame:
    """Medians per cluster of the metrics of the cell steps."""
    return summary(s, [s.result("generalqc"), s.result("bubbleqc").drop("_q"), s.result("doubletqc"), s.result("cellqc")])


STEPS = {
    "annotation": annotate, "generalqc": general_qc, "bubbleqc": bubble, "doubletqc": doublets, "doublet_molecules": doublet_molecules, "voidqc": voids, "cellqc": cell_qc,
    "hqcr_ident": hqcr, "hqcr_celltype": lambda s: hqcr(s, True), "hqtr": hqtr, "ambientqc": ambient, "local_ambient": local_ambient, "transcriptqc": molecule_qc,
    "combine": combined, "summary": summarised,
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source", help="folder of the bundle's Parquet tables")
    p.add_argument("target", help="folder for the results")
    p.add_argument("steps", nargs="+", choices=[*STEPS, "all"])
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("histolith").getOrCreate()
    section, store = Section(spark, a.source), MetricStore(spark, a.target)
    for name in STEPS if "all" in a.steps else a.steps:
        made = section.result(name)
        for part, df in made.items() if isinstance(made, dict) else [(name, made)]:
            store.write(f"{name}/{part}" if isinstance(made, dict) else name, df)
    remove_stages(spark)


if __name__ == "__main__":
    main()
