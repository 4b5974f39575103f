"""Queries of priors, expression models, voids, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.operators import delaunay as D
from histolith.operators import graphs, local_moran, mrf, priors, raster
from histolith.operators import models as M
from histolith.operators import tabular as T
from histolith.plans.sql import CELLS, EXPR, LABELS, TX, with_
from histolith.session import materialize, scratch_dir, table
from histolith.sources import bundle as B
from histolith.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_(ctes, sql)
        return fn

    return add


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/histolith/{name}-{uuid.uuid4().hex}"


# priors ----------------------------------------------------------------------------------------

SCALE = "(({x}) - min({x}) over ()) / nullif(max({x}) over () - min({x}) over (), 0)"


@query(
    f"select cell_id, round({SCALE.format(x='p')}, 6) as prior from (select cell_id, 1 - case when transcript_counts < 40 then 1 else exp(-0.5 * pow((transcript_counts - 40) / 15.0, 2)) / (15 * sqrt(2 * pi())) end as p from cells)",
    (CELLS,),
)
def proj07_tail_prior(spark: SparkSession, d: str) -> DataFrame:
    return priors.tail_prior(B.cells(spark, d), "transcript_counts", "prior", threshold=40, sd=15).select("cell_id", r6("prior").alias("prior"))


LEVELS = """m as (select leiden, avg(transcript_counts) as m from cells where leiden is not null group by 1),
lv as (select leiden, case when r < n // 3 then 'low' when r < 2 * n // 3 then 'mid' else 'high' end as level from (select leiden, row_number() over (order by m, leiden) - 1 as r, count(*) over () as n from m)),
lm as (select level, avg(transcript_counts) as lm from cells join lv using (leiden) group by 1),
bad as (select c.*, coalesce(case when (select min(lm) from lm) > 1 then level = (select level from lm order by lm, level limit 1) else transcript_counts < 1 end, false)::int as bad from cells c left join lv using (leiden))"""


@query("select cell_id, bad from bad", (CELLS, LEVELS))
def model17_bad_cluster(spark: SparkSession, d: str) -> DataFrame:
    return priors.bad_cluster_flags(B.cells(spark, d), "leiden", "transcript_counts").select("cell_id", "bad")


DISTANCE = """db as (select distinct doublet_id, x, y from doublet_df where isfinite(x) and isfinite(y)),
dist as (select cell_id, min(sqrt((c.x - d.x) * (c.x - d.x) + (c.y - d.y) * (c.y - d.y))) as dd from cells c left join db d on true group by 1),
pd as (select cell_id, 1 - (p - min(p) over ()) / nullif(max(p) over () - min(p) over (), 0) as p_doublet from (select cell_id, exp(-0.5 * pow(dd / 100.0, 2)) / (100 * sqrt(2 * pi())) as p from dist))"""


def _doublet_prior(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d).select("cell_id", "x", "y")
    near = graphs.nearest(c, table(spark, d, "doublet_df"), query_key="cell_id", point_key="doublet_id", within=100_000.0, first=10.0)
    return priors.distance_prior(c.select("cell_id").join(near, "cell_id", "left"), "distance", "p_doublet").select("cell_id", "p_doublet")


@query("select cell_id, round(p_doublet, 6) as p_doublet from pd", (CELLS, DISTANCE))
def model19_doublet_prior(spark: SparkSession, d: str) -> DataFrame:
    return _doublet_prior(spark, d).select("cell_id", r6("p_doublet").alias("p_doublet"))


GOOD = """pairs as (select a.cell_id as src, b.cell_id as dst from cells a, cells b where a.cell_id <> b.cell_id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 30),
good as (select c.cell_id, 1 - coalesce(avg(b.bad), 0) as p_good from cells c left join pairs p on p.src = c.cell_id left join bad b on b.cell_id = p.dst group by 1)"""


@query(f"select cell_id, round({SCALE.format(x='p_good + p_doublet')}, 6) as good_quality from good join pd using (cell_id)", (CELLS, LEVELS, DISTANCE, GOOD))
def model20_cell_prior(spark: SparkSession, d: str) -> DataFrame:
    return cell_prior(spark, d).select("cell_id", r6("good_quality").alias("good_quality"))


def cell_prior(spark: SparkSession, d: str) -> DataFrame:
    good = priors.good_neighbour_prior(priors.bad_cluster_flags(B.cells(spark, d), "leiden", "transcript_counts"))
    return priors.combine(good.join(_doublet_prior(spark, d), "cell_id"), ["p_good", "p_doublet"], "good_quality")


PIXELS = "c as (select px, py, count(*) as n from tx group by 1, 2), e as (select min(px) as x0, max(px) as x1, min(py) as y0, max(py) as y1 from c)"
LBP_GRID = """g0 as (select x0 + i as px, y0 + j as py from e, unnest(range(0, x1 - x0 + 1)) t(i), unnest(range(0, y1 - y0 + 1)) u(j)),
g as (select g0.px, g0.py, least(coalesce(n, 0) / 2.5::double, 1) as p from g0 left join c on c.px = g0.px and c.py = g0.py), un as (select px, py, -ln(1 - p + 1e-8) as u0, -ln(p + 1e-8) as u1 from g)"""
TAIL = "1 - case when {x} < {t} then 1 else exp(-0.5 * pow(({x} - {t}) / {s}, 2)) / ({s} * sqrt(2 * pi())) end"
DISK = """o as (select i as dx, j as dy from unnest(range(-3, 4)) t(i), unnest(range(-3, 4)) u(j) where i * i + j * j <= 9),
qv as (select px + dx as px, py + dy as py, sum(q) as s from (select px, py, avg(qv) as q from tx where qv is not null group by 1, 2), o group by 1, 2),
ac as (select px + dx as px, py + dy as py, sum(m) as a, sum(k) as b from (select px, py, max(coalesce(morans_i, 0)) as m, max(case when highly_variable then 1.0 when not highly_variable then 0.5 else 0 end) as k
from tx left join gene_panel using (gene) group by 1, 2), o group by 1, 2)"""


@query(
    f"""select px, py, round(s, 6) as belief, (s > 0.5)::int as mask from (select px, py, {SCALE.format(x='a + b + c')} as s from (
    select px, py, p as a, {SCALE.format(x='q')} as b, {SCALE.format(x='r')} as c from (select g.px, g.py, g.p, {TAIL.format(x='coalesce(qv.s, 0)', t=20.0, s=3.0)} as q, {TAIL.format(x='coalesce(ac.a * ac.b, 0)', t=0.4, s=1.0)} as r
    from g left join qv on qv.px = g.px and qv.py = g.py left join ac on ac.px = g.px and ac.py = g.py)))""",
    (TX, PIXELS, LBP_GRID, DISK),
)
def model21_pixel_prior(spark: SparkSession, d: str) -> DataFrame:
    """Structure, quality and ambient prior of every pixel, added and scaled; a panel flag stands for the local score, as in img03."""
    g = B.genes(spark, d).select("gene", "morans_i", F.when(F.col("highly_variable"), 1.0).otherwise(0.5).alias("local"))
    t = materialize(B.transcripts(spark, d).join(g, "gene", "left"), "molecules")
    ex = raster.Extent.of(t)
    n = t.groupBy("px", "py").agg(F.least(F.count(F.lit(1)) / 2.5, F.lit(1.0)).alias("p"))
    structure = raster.dense_grid(n, "p", ex).select("px", "py", F.col("p").cast("double").alias("p_structure"))
    p = priors.molecule_priors(structure, raster.quality_density(t, ex), raster.ambient_density(t, ("morans_i", "local"), ex))
    return p.select("px", "py", r6("p").alias("belief"), M.positive(F.col("p")).alias("mask"))


ARTEFACT = """art as (select *, case when nucleus_area is null or nucleus_area = 0 then 'nucleus_free' when control_codeword_counts > 0 and cell_area > (select avg(cell_area) from cells) then 'doublet' else 'none' end as artefact from cells)"""
QC = """qc as (select a.cell_id, celltype, artefact, transcript_counts::double as transcript_counts, coalesce(g, 0)::double as n_genes, coalesce(q, 0)::double as n_low_qv from art a
left join (select cell_id, count(*) as g from expr group by 1) using (cell_id) left join (select cell_id, count(*) as q from tx where qv < 20 group by 1) using (cell_id))"""
BOUNDS = """long as (select cell_id, celltype, artefact, metric, v from qc unpivot (v for metric in (transcript_counts, n_genes, n_low_qv)) where celltype is not null),
dist as (select celltype, metric, artefact, m, median(abs(v - m)) as mad, count(*) as n from (select *, median(v) over (partition by celltype, metric, artefact) as m from long) group by all),
wide as (select celltype, metric, coalesce(max(n) filter (artefact = 'none'), 0) as nc, max(m) filter (artefact = 'none') as mc, max(mad) filter (artefact = 'none') as dc,
coalesce(max(n) filter (artefact = 'doublet'), 0) as nd, max(m) filter (artefact = 'doublet') as md, max(mad) filter (artefact = 'doublet') as dd,
coalesce(max(n) filter (artefact = 'nucleus_free'), 0) as nf, max(m) filter (artefact = 'nucleus_free') as mf, max(mad) filter (artefact = 'nucleus_free') as df from dist group by 1, 2),
bounds as (select celltype, metric, case when nc = 0 then 0.0 when nf > 100 and (nd > 100 or nd = 0) then mf + df else mc - dc end as low,
case when nc = 0 then 0.0 when nd > 100 and (nf > 100 or nf = 0) then md - dd else mc + dc end as high from wide)"""
QC_METRICS = ["transcript_counts", "n_genes", "n_low_qv"]


def _artefacts(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d)
    c = T.one_row(c, c.agg(F.avg("cell_area").alias("_mean")))
    free = F.col("nucleus_area").isNull() | (F.col("nucleus_area") == 0)
    return c.withColumn("artefact", F.when(free, "nucleus_free").when((F.col("control_codeword_counts") > 0) & (F.col("cell_area") > F.col("_mean")), "doublet").otherwise("none")).drop("_mean")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, x, y, celltype, artefact and the three metrics that have bounds."""
    t = materialize(B.transcripts(spark, d).select("cell_id", "gene", "qv"), "molecules")
    genes = B.expression(t).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"))
    low = t.where(F.col("qv") < 20).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_low_qv"))
    c = _artefacts(spark, d).select("cell_id", "x", "y", "celltype", "artefact", "transcript_counts")
    return c.join(genes, "cell_id", "left").join(low, "cell_id", "left").fillna(0, ["n_genes", "n_low_qv"])


@query("select celltype, metric, round(low, 6) as low, round(high, 6) as high from bounds", (TX, EXPR, CELLS, ARTEFACT, QC, BOUNDS))
def model23_celltype_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = priors.celltype_bounds(_quality(spark, d), QC_METRICS)
    return b.select("celltype", "metric", r6("low").alias("low"), r6("high").alias("high"))


@query(
    """select cell_id, coalesce(transcript_counts < low or transcript_counts > high, false)::int as outside from art left join (select * from bounds where metric = 'transcript_counts') using (celltype)""",
    (TX, EXPR, CELLS, ARTEFACT, QC, BOUNDS),
)
def model24_refined_class(spark: SparkSession, d: str) -> DataFrame:
    c = _quality(spark, d)
    return priors.outside_bounds(c, priors.celltype_bounds(c, ["transcript_counts"]), "transcript_counts").select("cell_id", "outside")


@query(
    """select c.cell_id, round(1 - coalesce(avg(n.outside), 0), 6) as p_good from out c left join out n on n.cell_id <> c.cell_id and abs(n.x - c.x) <= 30 and abs(n.y - c.y) <= 30
    and sqrt((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y)) <= 30 group by 1""",
    (TX, EXPR, CELLS, ARTEFACT, QC, BOUNDS, """out as (select cell_id, x, y, coalesce(transcript_counts < low or transcript_counts > high, false)::int as outside from art left join (select * from bounds where metric = 'transcript_counts') using (celltype))"""),
)
def model24_refined_prior(spark: SparkSession, d: str) -> DataFrame:
    """Share of the neighbours that lie within the bounds of their cell type."""
    c = materialize(_quality(spark, d), "quality")
    flagged = priors.outside_bounds(c, priors.celltype_bounds(c, ["transcript_counts"]), "transcript_counts")
    return priors.good_neighbour_prior(flagged, "outside").select("cell_id", r6("p_good").alias("p_good"))


@query()
def model14_cluster_prior(spark: SparkSession, d: str) -> DataFrame:
    s = B.cells(spark, d).where(F.col("leiden").isNotNull()).groupBy("leiden").agg(F.avg("transcript_counts").alias("score"))
    return priors.pixel_prior(s, "score", "p_informative")


# belief propagation -------------------------------------------------------------------------------

def _lbp_step(name: str, before: list[tuple[str, int, int]]) -> str:
    """Messages of one direction of the first iteration: own messages are 0 before."""
    joins = "".join(f" left join {n} m{i} on m{i}.px = u.px + {dx} and m{i}.py = u.py + {dy}" for i, (n, dy, dx) in enumerate(before))
    cost = [f"u.u{s}" + "".join(f" + coalesce(m{i}.v{s}, 0)" for i in range(len(before))) for s in (0, 1)]
    return f"""{name} as (select px, py, 0.3 * a / case when a + b = 0 then 1e-8 else a + b end as v0, 0.3 * b / case when a + b = 0 then 1e-8 else a + b end as v1 from (
    select px, py, least(h0, h1 + 1.5) as a, least(h0 + 1.5, h1) as b from (select u.px, u.py, {cost[0]} as h0, {cost[1]} as h1 from un u{joins})))"""


LBP = ",\n".join(
    [
        _lbp_step("mu", []),
        _lbp_step("md", [("mu", -1, 0)]),
        _lbp_step("ml", [("mu", -1, 0), ("md", 1, 0)]),
        _lbp_step("mr", [("mu", -1, 0), ("md", 1, 0), ("ml", 0, -1)]),
    ]
)
LBP_READ = "".join(f" left join {n} on {n}.px = u.px + {dx} and {n}.py = u.py + {dy}" for n, dy, dx in (("mu", -1, 0), ("md", 1, 0), ("ml", 0, -1), ("mr", 0, 1)))
LBP_SUM = [f"u.u{s} + coalesce(mu.v{s}, 0) + coalesce(md.v{s}, 0) + coalesce(ml.v{s}, 0) + coalesce(mr.v{s}, 0)" for s in (0, 1)]


def _pixel_probability(spark: SparkSession, d: str) -> tuple[DataFrame, raster.Extent]:
    """Probability of pixels by their molecules: 1 from 2.5 on."""
    n = B.transcripts(spark, d).groupBy("px", "py").agg(F.least(F.count(F.lit(1)) / 2.5, F.lit(1.0)).alias("p"))
    return n, raster.Extent.of(n)


@query(
    f"select px, py, round(b0 / case when b0 + b1 = 0 then 1e-8 else b0 + b1 end, 6) + 0.0 as belief, (b0 > b1)::int as label from (select u.px, u.py, {LBP_SUM[0]} as b0, {LBP_SUM[1]} as b1 from un u{LBP_READ})",
    (TX, PIXELS, LBP_GRID, LBP),
)
def model01_belief_one_iteration(spark: SparkSession, d: str) -> DataFrame:
    p, ex = _pixel_probability(spark, d)
    return mrf.smooth(p, "p", ex, iterations=1).select("px", "py", (r6("belief") + 0.0).alias("belief"), "label")


@query()
def model01_belief_propagation(spark: SparkSession, d: str) -> DataFrame:
    p, ex = _pixel_probability(spark, d)
    return mrf.smooth(p, "p", ex)


# expression models -----------------------------------------------------------------------------------


@query(
    """select e.cell_id, e.gene, round(ln(1 + e.n * (select median(t) from (select sum(n) as t from expr group by cell_id)) / t.t), 6) as normlog from expr e join (select cell_id, sum(n) as t from expr group by 1) t using (cell_id)""",
    (TX, EXPR),
)
def model25_normalised(spark: SparkSession, d: str) -> DataFrame:
    return M.normalise(B.expression(B.transcripts(spark, d))).select("cell_id", "gene", r6("normlog").alias("normlog"))


@query(
    """select gene, round(m, 6) as mean, round(sqrt(greatest((ss - c * m * m) / (c - 1), 0)), 6) as sd from (select gene, sum(n) / c::double as m, sum(n * n)::double as ss, c from expr, (select count(distinct cell_id) as c from expr) group by gene, c)""",
    (TX, EXPR),
)
def model25_gene_scale(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(B.expression(B.transcripts(spark, d)), "expression")
    n = e.select("cell_id").distinct().count()
    return M.scale(e, n, "n").select("gene", r6("mean").alias("mean"), r6("sd").alias("sd")).distinct()


@query()
def model25_variable_genes(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(B.expression(B.transcripts(spark, d)), "expression")
    return M.variable_genes(e, e.select("cell_id").distinct().count())


@query()
def model13_pixel_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Texture clusters of pixels and their scores, as structure minus anti-structure."""
    n = materialize(B.transcripts(spark, d).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n")), "counts")
    ex = raster.Extent.of(n)
    metrics = raster.pixel_metric(n, "n", ex, "texture").join(raster.pixel_metric(n, "n", ex, "energy"), ["px", "py"]).join(raster.pixel_metric(n, "n", ex, "edge"), ["px", "py"])
    metrics = materialize(metrics, "metrics")
    features = ["entropy", "energy", "edge", "homogeneity", "uniformity"]
    clustered = M.kmeans(M.assemble(metrics, features, ["px", "py", *features]), 100, ["px", "py", *features])
    return M.cluster_scores(clustered, "cluster", ["edge", "energy", "entropy"], ["homogeneity", "uniformity"])


#: Genes that a panel may have, each a column of the matrix of cells.
MOST_GENES = 10_000


def _panel(spark: SparkSession, d: str) -> list[str]:
    """The variable genes of the panel; a panel is bounded, and a longer list is an error."""
    names = [r["gene"] for r in B.genes(spark, d).where("highly_variable").select("gene").distinct().orderBy("gene").limit(MOST_GENES + 1).collect()]
    if len(names) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} variable genes")
    return names


@query()
def model26_components(spark: SparkSession, d: str) -> DataFrame:
    """Explained and cumulative variance of the expression's principal components."""
    e = M.normalise(B.expression(B.transcripts(spark, d)))
    panel = _panel(spark, d)
    v = materialize(M.gene_vectors(e, B.cells(spark, d), panel), "vectors")
    _, explained = M.principal_components(v, min(len(panel), 100 if v.count() >= 100 else 10))
    rows = [(i + 1, v, sum(explained[: i + 1])) for i, v in enumerate(explained)]
    return spark.createDataFrame(rows, "pc int, explained double, cumulative double")


@query()
def model28_cluster_search(spark: SparkSession, d: str) -> DataFrame:
    e = M.normalise(B.expression(B.transcripts(spark, d)))
    pcs, _ = M.principal_components(materialize(M.gene_vectors(e, B.cells(spark, d), _panel(spark, d)), "vectors"), 10)
    v = materialize(pcs.select("cell_id", *[F.get("pcs", F.lit(i)).alias(f"p{i}") for i in range(10)]), "pcs")
    target = B.cells(spark, d).agg(F.count_distinct("celltype")).first()[0] + 3
    return M.resolution_search(M.assemble(v, [f"p{i}" for i in range(10)], ["cell_id"]), [max(2, target - 3), target, target + 3], [1, 2, 3, 4, 5], target)


@query()
def model30_gene_set_score(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(B.expression(B.transcripts(spark, d)), "expression")
    return M.gene_set_score(e, B.cells(spark, d), B.genes(spark, d).where("ribo").select("gene")).select("cell_id", r6("score").alias("score"))


@query()
def model31_cell_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Phase fractions per sample; the panel's flags stand for the gene lists of the phases."""
    e = materialize(B.expression(B.transcripts(spark, d)), "expression")
    g, c = B.genes(spark, d), B.cells(spark, d)
    phases = M.cell_cycle_phase(e, c, g.where("mt").select("gene"), g.where("ribo").select("gene"))
    return T.group_fraction(phases.join(c.select("cell_id", "sample"), "cell_id"), "sample", "phase")


@query()
def model11_local_moran(spark: SparkSession, d: str) -> DataFrame:
    return local_moran.local_moran(B.cells(spark, d), B.expression(B.transcripts(spark, d)))


@query()
def model12_molecule_scores(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(B.transcripts(spark, d).where(F.col("gene") != B.NO_GENE).select("transcript_id", "cell_id", "gene", "x", "y"), "molecules")
    local = materialize(local_moran.local_moran(B.cells(spark, d), B.expression(t)), "local")
    return local_moran.molecule_scores(t, local)


# voids ------------------------------------------------------------------------------------------------


def _voids(spark: SparkSession, d: str) -> DataFrame:
    return materialize(D.void_clusters(D.delaunay(B.cells(spark, d))), "voids")


@query()
def model06_delaunay(spark: SparkSession, d: str) -> DataFrame:
    return D.delaunay(B.cells(spark, d)).select("a", "b", "c", r6("longest").alias("longest"))


@query()
def model07_void_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _voids(spark, d).select("a", "b", "c", "cluster", "n_triangles")


@query()
def model08_void_counts(spark: SparkSession, d: str) -> DataFrame:
    v = _voids(spark, d)
    outside = B.transcripts(spark, d).where(F.col("cell_id") == -1).withColumn("low", F.coalesce(F.col("qv") < 20, F.lit(False)))
    return D.void_counts(v, outside, point_key="transcript_id", flag="low")


@query()
def model09_outside_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Molecules outside of cells in the triangles at each cell."""
    v = _voids(spark, d)
    n = D.void_counts(v, B.transcripts(spark, d).where(F.col("cell_id") == -1), point_key="transcript_id")
    return D.incident_sums(v, n, B.cells(spark, d))


@query()
def agg31_void_sums(spark: SparkSession, d: str) -> DataFrame:
    v = _voids(spark, d)
    return D.cluster_sums(v, D.void_counts(v, B.transcripts(spark, d).where(F.col("cell_id") == -1), point_key="transcript_id"))


@query()
def img15_regions(spark: SparkSession, d: str) -> DataFrame:
    """Bounding boxes of the 8-connected regions of dense pixels, boxes that overlap merged."""
    t = B.transcripts(spark, d).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    ex = raster.Extent.of(t)
    dense = raster.window_map(t.where(F.col("n") >= 3).select("px", "py", F.lit(1).alias("m")), "m", ex, raster.dilate(2), ["mask"], radius=2).where(F.col("mask") > 0)
    from histolith.operators.regions import bounding_boxes, connected_regions, merge_boxes

    return merge_boxes(bounding_boxes(connected_regions(dense.select("px", "py")), least_area=200))


# files and streams --------------------------------------------------------------------------------------


@query("select barcode as Barcode, nullif(regexp_replace(cluster, '[^A-Za-z0-9]', '', 'g'), '') as Cluster from annotation where barcode is not null")
def src03_annotation_file(spark: SparkSession, d: str) -> DataFrame:
    """The annotation, written as a delimited file and read with its separator found out."""
    path = scratch(spark, "annotation")
    files.write_annotation(table(spark, d, "annotation").where(F.col("barcode").isNotNull()), path, "barcode", "cluster")
    return files.read_annotation(spark, path).select("Barcode", F.when(F.col("Cluster") != "", F.col("Cluster")).alias("Cluster"))


@query("select 'S' as phase, gene from gene_panel where mt union all select 'G2M', gene from gene_panel where ribo")
def src04_phase_genes_file(spark: SparkSession, d: str) -> DataFrame:
    g, path = B.genes(spark, d), scratch(spark, "phases")
    one = g.agg(F.collect_list(F.when(F.col("mt"), F.col("gene"))).alias("S"), F.collect_list(F.when(F.col("ribo"), F.col("gene"))).alias("G2M"))
    one.coalesce(1).write.json(path)
    return files.read_phase_genes(spark, path)


GTF = """select line_no, nullif(regexp_extract(attribute, '(?:^|[;|,\\t\\s])gene_name[ =]+["'']?([A-Za-z0-9._-]+)', 1), '') as gene_name from gene_annotation where feature = 'gene'"""


@query(GTF)
def src05_gene_models(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "gene_annotation").where(F.col("feature") == "gene")
    return files.gene_models(lines, "line_no").select("line_no", "gene_name")


@query(
    "select c.cell_id, round(c.cell_area, 3) as cell_area, e.total from cells c left join (select cell_id, sum(n)::bigint as total from expr group by 1) e using (cell_id)",
    (TX, CELLS, EXPR),
)
def src06_metric_store(spark: SparkSession, d: str) -> DataFrame:
    store = files.MetricStore(spark, scratch(spark, "metrics"))
    c = B.cells(spark, d)
    store.write("area", c.select("cell_id", r6("cell_area", 3).alias("cell_area")))
    store.write("totals", B.expression(B.transcripts(spark, d)).groupBy("cell_id").agg(F.sum("n").alias("total")))
    return store.join(c.select("cell_id"))


@query("select cell_id, celltype from cells where celltype = 'Stroma'", (CELLS,))
def src11_partitioned_store(spark: SparkSession, d: str) -> DataFrame:
    store = files.MetricStore(spark, scratch(spark, "types"))
    store.write("types", B.cells(spark, d).where(F.col("celltype").isNotNull()).select("cell_id", "celltype"), ["celltype"])
    return store.read("types").where(F.col("celltype") == "Stroma").select("cell_id", "celltype")


@query("select cell_id, label from labels", (LABELS,))
def src13_labels(spark: SparkSession, d: str) -> DataFrame:
    return B.annotation(spark, d)


@query("select x::int as px, y::int as py, count(*) as n from (select trunc(x) as x, trunc(y) as y from transcripts) group by 1, 2")
def stream01_pixel_counts(spark: SparkSession, d: str) -> DataFrame:
    from histolith.streaming.pixels import run_to_table, stream_pixel_counts

    src = table(spark, d, "transcripts").select("x", "y")
    path = f"{d}/transcripts.parquet"
    stream = spark.readStream.schema(src.schema).parquet(path if _is_dir(spark, path) else f"{d}/transcripts.parque[t]")
    return run_to_table(spark, stream_pixel_counts(stream), "complete", "pixel_counts")


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())
