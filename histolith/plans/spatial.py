"""Queries over positions, rings and graphs, each with its SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histolith.operators import geometry as G
from histolith.operators import graphs
from histolith.operators import tabular as T
from histolith.operators.proximity import points_in_rings, points_within
from histolith.plans.sql import CELLS, EDGES, EXPR, RINGS, TX, with_
from histolith.session import materialize, spread, table
from histolith.sources import bundle as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PAIRS = "pairs as (select a.cell_id as src, b.cell_id as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance from cells a, cells b where a.cell_id <> b.cell_id and abs(a.x - b.x) <= 50 and abs(a.y - b.y) <= 50 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50)"
DOUBLETS = "db as (select distinct doublet_id, x, y from doublet_df where isfinite(x) and isfinite(y))"


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_(ctes, sql)
        return fn

    return add


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@query("select c.cell_id, count(p.dst) as neighbours from cells c left join (select * from pairs where distance <= 30) p on p.src = c.cell_id group by 1", (CELLS, PAIRS))
def join08_radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graphs.neighbour_counts(B.cells(spark, d), 30.0)


@query("select src as cell_id, dst as cell_id_near from pairs where distance <= 15 union all select cell_id, cell_id from cells", (CELLS, PAIRS))
def join09_radius_pairs_with_self(spark: SparkSession, d: str) -> DataFrame:
    return graphs.radius_pairs(B.cells(spark, d), 15.0, include_self=True).select(F.col("src").alias("cell_id"), F.col("dst").alias("cell_id_near"))


@query(
    """select transcript_id, distance from (select q.transcript_id, round(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), 6) as distance, row_number() over (partition by q.transcript_id order by
    (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) as rk from tx q join tx p on p.gene = q.gene and abs(q.x - p.x) < 100 and abs(q.y - p.y) < 100 where q.cell_id = -1 and p.cell_id <> -1 and q.gene <> 'NaN'
    and sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 100) where rk = 1""",
    (TX,),
)
def join10_nearest_of_same_gene(spark: SparkSession, d: str) -> DataFrame:
    """For each molecule outside of cells the nearest one of its gene inside of a cell, less than 100 away."""
    t = materialize(B.transcripts(spark, d).where(F.col("gene") != B.NO_GENE).select("transcript_id", "gene", "cell_id", "x", "y"), "molecules")
    outside, inside = t.where(F.col("cell_id") == -1), t.where(F.col("cell_id") != -1).withColumnRenamed("transcript_id", "nearest_id")
    near = graphs.nearest(outside, inside, query_key="transcript_id", point_key="nearest_id", by="gene", within=100.0)
    return near.select("transcript_id", r6("distance").alias("distance"))


INSIDE = """hit as (select cell_id, doublet_id from (select b.cell_id, d.doublet_id, sum(case when ay <= d.y and by_ > d.y and (bx - ax) * (d.y - ay) - (d.x - ax) * (by_ - ay) > 0 then 1
  when ay > d.y and by_ <= d.y and (bx - ax) * (d.y - ay) - (d.x - ax) * (by_ - ay) < 0 then -1 else 0 end) as w
  from (select cell_id, min(ax) as x0, max(ax) as x1, min(ay) as y0, max(ay) as y1 from edges group by 1) b join db d on d.x between x0 and x1 and d.y between y0 and y1 join edges e on e.cell_id = b.cell_id group by 1, 2) where w <> 0)"""


@query(
    "select r.cell_id, count(h.doublet_id) as n_members from rings r left join (select distinct * from hit) h using (cell_id) group by 1",
    (RINGS, EDGES, DOUBLETS, INSIDE),
)
def join11_points_per_ring(spark: SparkSession, d: str) -> DataFrame:
    members = G.contained_points(table(spark, d, "doublet_df"), B.rings(spark, d), "doublet_id", "cell_id")
    return members.select("cell_id", F.size("members").cast("long").alias("n_members"))


@query()
def join13_overlap_area(spark: SparkSession, d: str) -> DataFrame:
    return G.overlap_area(B.rings(spark, d), "cell_id").select("cell_id", r6("overlap_area").alias("overlap_area"))


@query(
    """select cell_id, round(least(100000.0, coalesce(min(sqrt((c.x - d.x) * (c.x - d.x) + (c.y - d.y) * (c.y - d.y))), 100000.0)), 6) as doublet_distance,
    coalesce(min(sqrt((c.x - d.x) * (c.x - d.x) + (c.y - d.y) * (c.y - d.y))) <= 10, false) as doublet from cells c left join db d on true group by 1""",
    (CELLS, DOUBLETS),
)
def join14_doublet_distance(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d).select("cell_id", "x", "y")
    near = graphs.nearest(c, table(spark, d, "doublet_df"), query_key="cell_id", point_key="doublet_id", within=100_000.0, first=10.0)
    gap = F.coalesce("distance", F.lit(100_000.0))
    return c.select("cell_id").join(near, "cell_id", "left").select("cell_id", r6(gap).alias("doublet_distance"), (gap <= 10).alias("doublet"))


@query(
    "select t.transcript_id from tx t where exists (select 1 from db d where abs(t.x - d.x) <= 10 and abs(t.y - d.y) <= 10 and sqrt((t.x - d.x) * (t.x - d.x) + (t.y - d.y) * (t.y - d.y)) <= 10)",
    (TX, DOUBLETS),
)
def join15_molecules_near_doublets(spark: SparkSession, d: str) -> DataFrame:
    near = points_within(B.transcripts(spark, d), table(spark, d, "doublet_df"), 10.0, query_key="transcript_id", point_key="doublet_id")
    return near.select("transcript_id").distinct()


@query("select cell_id, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) as area, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 6) as perimeter from edges group by cell_id", (RINGS, EDGES))
def geom01_area_perimeter(spark: SparkSession, d: str) -> DataFrame:
    return B.rings(spark, d).select("cell_id", r6(G.area(F.col("ring"))).alias("area"), r6(G.perimeter(F.col("ring"))).alias("perimeter"))


@query(
    """select cell_id, a > q and t > 0.1 as bubble from (select cell_id, a, 4 * pi() * a / nullif(p * p, 0) as t, quantile_cont(a, 0.9) over () as q from (
    select cell_id, abs(sum(ax * by_ - bx * ay)) / 2 as a, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) as p from edges group by cell_id) where a > 0)""",
    (RINGS, EDGES),
)
def geom01_bubbles(spark: SparkSession, d: str) -> DataFrame:
    """Large compact cells: area above the 0.9 quantile and thinness above 0.1."""
    ring = F.col("ring")
    r = B.rings(spark, d).select("cell_id", G.area(ring).alias("a"), G.thinness(ring).alias("t")).where(F.col("a") > 0)
    return T.one_row(r, r.agg(F.percentile("a", F.lit(0.9)).alias("q"))).select("cell_id", ((F.col("a") > F.col("q")) & (F.col("t") > 0.1)).alias("bubble"))


@query(
    """select cell_id, round(greatest(count(*) filter (turn > 0), count(*) filter (turn < 0)) / (m + 1)::double, 6) as convexity from (
    select cell_id, m, (bx - ax) * (cy - by_) - (by_ - ay) * (cx - bx) as turn from (select cell_id, m, i, r[i].x as ax, r[i].y as ay, r[i % (m + 1) + 1].x as bx, r[i % (m + 1) + 1].y as by_, r[(i + 1) % (m + 1) + 1].x as cx, r[(i + 1) % (m + 1) + 1].y as cy
    from (select cell_id, len(o) as m, o || [o[1]] as r, unnest(range(1, len(o) + 2)) as i from (select cell_id, case when ring[1] = ring[len(ring)] then ring[1:len(ring) - 1] else ring end as o from rings)))) where m >= 3 group by cell_id, m""",
    (RINGS,),
)
def geom02_convexity(spark: SparkSession, d: str) -> DataFrame:
    return B.rings(spark, d).select("cell_id", r6(G.convexity(F.col("ring"))).alias("convexity")).where(F.col("convexity").isNotNull())


@query(
    """select cell_id, round(sum((ax + bx) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 4) as cx, round(sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 4) as cy
    from edges group by cell_id having abs(sum(ax * by_ - bx * ay)) > 1e-6""",
    (RINGS, EDGES),
)
def geom03_centroid(spark: SparkSession, d: str) -> DataFrame:
    r = B.rings(spark, d).where(G.area(F.col("ring")) > 5e-7).select("cell_id", G.centroid(F.col("ring")).alias("c"))
    return r.select("cell_id", r6("c.x", 4).alias("cx"), r6("c.y", 4).alias("cy"))


@query()
def geom04_repaired(spark: SparkSession, d: str) -> DataFrame:
    fixed = G.repair_rings(table(spark, d, "cell_boundaries"), "cell_id")
    return fixed.select("cell_id", "valid", r6(F.when(F.col("ring").isNotNull(), G.area(F.col("ring")))).alias("area"))


@query(
    """select cell_id, i - 1 as i, trunc(ax)::int - x0 + 1 as px, trunc(ay)::int - y0 + 1 as py from edges, ext""",
    (RINGS, EDGES, TX, """ext as (select min(px) as x0, min(py) as y0 from (select px, py from tx union all select trunc(ax)::int, trunc(ay)::int from edges))"""),
)
def geom05_section_rings(spark: SparkSession, d: str) -> DataFrame:
    """All vertices as pixels of the whole section, whose first pixel is (1, 1); the extent is that of the molecules and the rings."""
    from histolith.operators import raster

    rings = B.rings(spark, d)
    vertices = rings.select(F.explode("ring").alias("v")).select(F.col("v.x").cast("int").alias("px"), F.col("v.y").cast("int").alias("py"))
    ex = raster.Extent.of(B.transcripts(spark, d).select("px", "py").unionByName(vertices)) or raster.Extent(0, 0, 0, 0)
    # The window of snap_to_pixels begins at pixel 0, which is one before the section.
    r = rings.select("cell_id", F.posexplode(G.snap_to_pixels(F.col("ring"), ex.x0, ex.y0, ex.width + 1, ex.height + 1)).alias("i", "v"))
    return r.select("cell_id", F.col("i").cast("long").alias("i"), F.col("v.x").alias("px"), F.col("v.y").alias("py"))


@query(
    """select px, py, round(avg(transcript_counts), 6) as mean, count(*) as rings from cov join cells using (cell_id) group by 1, 2""",
    (
        CELLS, RINGS, EDGES,
        """box as (select cell_id, floor(min(ax))::int as x0, floor(max(ax))::int as x1, floor(min(ay))::int as y0, floor(max(ay))::int as y1 from edges group by 1)""",
        """pix as (select cell_id, x0 + i as px, y0 + j as py from box, unnest(range(0, x1 - x0 + 1)) t(i), unnest(range(0, y1 - y0 + 1)) u(j))""",
        """cov as (select p.cell_id, px, py from pix p join edges e using (cell_id) where (ay > py + 0.5) <> (by_ > py + 0.5) group by 1, 2, 3
           having sum(case when px + 0.5 < ax + (py + 0.5 - ay) / (by_ - ay) * (bx - ax) then 1 else 0 end) % 2 = 1)""",
    ),
)
def img17_rasterised_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean transcript count of the cells that cover each pixel."""
    from histolith.operators import raster

    r = spread(B.rings(spark, d)).join(B.cells(spark, d).select("cell_id", F.col("transcript_counts").cast("double").alias("v")), "cell_id")
    pixels = raster.rasterise(r, ["cell_id", "v"])
    return pixels.groupBy("px", "py").agg(r6(F.avg("v")).alias("mean"), F.count(F.lit(1)).alias("rings"))


@query()
def img18_rasterised_owner(spark: SparkSession, d: str) -> DataFrame:
    from histolith.operators import raster

    return raster.rasterised_owner(spread(B.rings(spark, d)), "cell_id")


@query()
def model04_islands(spark: SparkSession, d: str) -> DataFrame:
    return graphs.islands(B.cells(spark, d))


ORACLES["model04_islands"] = (
    "with recursive "
    + CELLS
    + """,
e as (select a.cell_id as a, b.cell_id as b from cells a, cells b where abs(a.x - b.x) <= 15 and abs(a.y - b.y) <= 15 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 15),
reach as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b),
c as (select a as cell_id, min(b) as component from reach group by a)
select cell_id, component, count(*) over (partition by component) as island_size, count(*) over (partition by component) < 10 as small_island from c"""
)


@query(
    """select c.cell_id, round(coalesce(s, 0), 6) as border_score, coalesce(s, 0) >= 1 as border from cells c left join (select src, max(abs(log2((p + 1) / (n + 1)::double))) as s from (
    select src, k, count(*) filter (v > 0) as p, count(*) filter (v < 0) as n from (select src, k, round((b.x - a.x) * cs + (b.y - a.y) * sn, 9) as v from pairs join cells a on a.cell_id = src join cells b on b.cell_id = dst
    cross join (select k, round(cos(2 * pi() * k / 36), 12) as cs, round(sin(2 * pi() * k / 36), 12) as sn from unnest(range(0, 18)) t(k))) group by 1, 2) group by 1) z on z.src = c.cell_id""",
    (CELLS, PAIRS),
)
def model05_border_score(spark: SparkSession, d: str) -> DataFrame:
    return graphs.border_scores(B.cells(spark, d)).select("cell_id", r6("border_score").alias("border_score"), "border")


W30 = "w as (select src, dst, 1.0::double / count(*) over (partition by src) as w from pairs where distance <= 30)"


@query(
    """select gene, round(n * num / den / s0, 6) as morans_i from (select gene, n, s0, sum(x * x) - n * m * m as den, sum(xy) - m * sum(x * r) - m * sum(x * c) + m * m * s0 as num from (
      select e.gene, e.n::double as x, coalesce(r, 0) as r, coalesce(c, 0) as c, (select count(*) from cells) as n, (select sum(w) from w) as s0, sum(e.n::double) over (partition by e.gene) / (select count(*) from cells) as m,
        coalesce((select sum(w.w * f.n) from w join expr f on f.cell_id = w.dst and f.gene = e.gene where w.src = e.cell_id), 0) * e.n as xy
      from expr e join cells using (cell_id) left join (select dst, sum(w) as c from w group by 1) wc on wc.dst = e.cell_id left join (select src, sum(w) as r from w group by 1) wr on wr.src = e.cell_id) group by gene, n, s0, m)""",
    (TX, CELLS, EXPR, PAIRS, W30),
)
def model10_global_moran(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of every gene over the cells within 30."""
    c = B.cells(spark, d)
    edges = materialize(graphs.radius_pairs(c, 30.0).select("src", "dst"), "edges")
    expr = materialize(B.expression(B.transcripts(spark, d)).join(c.select("cell_id"), "cell_id", "left_semi"), "expression")
    return graphs.moran(expr, edges, c).select("gene", r6("morans_i").alias("morans_i"))


@query(
    """select c.cell_id, round(1 - coalesce(avg(case when b.transcript_counts < 40 then 1.0 else 0.0 end), 0), 6) as good_prior from cells c left join (select * from pairs where distance <= 30) p on p.src = c.cell_id left join cells b on b.cell_id = p.dst group by 1""",
    (CELLS, PAIRS),
)
def model18_good_neighbours(spark: SparkSession, d: str) -> DataFrame:
    s = graphs.neighbour_share(B.cells(spark, d), F.col("transcript_counts") < 40, radius=30.0)
    return s.select("cell_id", r6(1 - F.col("share")).alias("good_prior"))


@query()
def model27_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of cells by label propagation, neighbours weighted by likeness of their metrics."""
    c = B.cells(spark, d)
    m = c.select("cell_id", F.log1p("transcript_counts").alias("a"), F.log1p(F.coalesce("cell_area", F.lit(0.0))).alias("b"))
    e = graphs.radius_pairs(c, 25.0).join(m.toDF("src", "a1", "b1"), "src").join(m.toDF("dst", "a2", "b2"), "dst")
    likeness = F.exp(-(F.pow(F.col("a1") - F.col("a2"), 2) + F.pow(F.col("b1") - F.col("b2"), 2)))
    return graphs.communities(c, materialize(e.select("src", "dst", likeness.alias("weight")), "edges"))


MARKERS = """mk as (select celltype, gene from (select celltype, gene, row_number() over (partition by celltype order by sum(n) desc, gene) as rk from expr join cells using (cell_id) where celltype is not null group by 1, 2) where rk <= 3)"""
RADII = [20, 30, 40, 80, 100]


@query(
    """select celltype, gene, radius, round(avg(m), 6) as mean_of_means, count(*) as n_cells from (select a.celltype, mk.gene, r.radius, p.src, sum(coalesce(e.n, 0)) / count(*)::double as m
    from (select a.cell_id as src, b.cell_id as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance from cells a, cells b where a.cell_id <> b.cell_id and abs(a.x - b.x) <= 100 and abs(a.y - b.y) <= 100) p
    join cells a on a.cell_id = p.src join mk on mk.celltype = a.celltype join (select unnest([20, 30, 40, 80, 100]) as radius) r on p.distance <= r.radius left join expr e on e.cell_id = p.dst and e.gene = mk.gene group by 1, 2, 3, 4) group by 1, 2, 3""",
    (TX, CELLS, EXPR, MARKERS),
)
def agg37_marker_in_radius(spark: SparkSession, d: str) -> DataFrame:
    """For each cell type, its three most counted genes and each radius, the mean over its cells of the mean count in the cells around."""
    c = B.cells(spark, d)
    expr = materialize(B.expression(B.transcripts(spark, d)), "expression")
    totals = expr.join(c.where(F.col("celltype").isNotNull()).select("cell_id", "celltype"), "cell_id").groupBy("celltype", "gene").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("celltype").orderBy(F.col("n").desc(), "gene")
    markers = totals.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 3).select("celltype", "gene")
    found = graphs.marker_in_radius(c, expr, markers, RADII)
    return found.select("celltype", "gene", "radius", r6("mean_of_means").alias("mean_of_means"), "n_cells")


@query(
    "select cell_id, count(*) as n, (count(*) > 1) as multi from (select distinct * from hit) group by 1",
    (RINGS, EDGES, DOUBLETS, INSIDE),
)
def agg24_members_per_cell(spark: SparkSession, d: str) -> DataFrame:
    hits = points_in_rings(table(spark, d, "doublet_df"), B.rings(spark, d), point_key="doublet_id", ring_key="cell_id")
    return hits.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("multi"))


@query(
    """select c.cell_id, coalesce(round(avg(v), 6), 0) as mean_convexity, coalesce(round(min(v), 6), 0) as min_convexity from cells c left join (select cell_id, greatest(count(*) filter (turn > 0), count(*) filter (turn < 0)) / (m + 1)::double as v from (
    select cell_id, m, (bx - ax) * (cy - by_) - (by_ - ay) * (cx - bx) as turn from (select cell_id, m, i, r[i].x as ax, r[i].y as ay, r[i % (m + 1) + 1].x as bx, r[i % (m + 1) + 1].y as by_, r[(i + 1) % (m + 1) + 1].x as cx, r[(i + 1) % (m + 1) + 1].y as cy
    from (select cell_id, len(o) as m, o || [o[1]] as r, unnest(range(1, len(o) + 2)) as i from (select cell_id, case when ring[1] = ring[len(ring)] then ring[1:len(ring) - 1] else ring end as o from rings)))) where m >= 3 group by cell_id, m) q using (cell_id) group by 1""",
    (CELLS, RINGS),
)
def agg25_convexity_per_cell(spark: SparkSession, d: str) -> DataFrame:
    """Mean and least convexity of the rings of each cell, 0 without a ring."""
    v = B.rings(spark, d).select("cell_id", G.convexity(F.col("ring")).alias("v")).groupBy("cell_id").agg(F.avg("v").alias("m"), F.min("v").alias("l"))
    out = B.cells(spark, d).select("cell_id").join(v, "cell_id", "left")
    return out.select("cell_id", F.coalesce(r6("m"), F.lit(0.0)).alias("mean_convexity"), F.coalesce(r6("l"), F.lit(0.0)).alias("min_convexity"))


@query()
def join12_molecules_in_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Molecules outside of cells and the triangle between cells that holds them."""
    from histolith.operators import delaunay

    t = delaunay.delaunay(B.cells(spark, d)).withColumn("tid", F.concat_ws("-", "a", "b", "c"))
    outside = B.transcripts(spark, d).where(F.col("cell_id") == B.NO_CELL)
    return points_in_rings(outside, t, point_key="transcript_id", ring_key="tid")


@query()
def join16_triangles_at_cells(spark: SparkSession, d: str) -> DataFrame:
    """Triangles each cell is a corner of, and their longest edge."""
    from histolith.operators import delaunay

    t = delaunay.delaunay(B.cells(spark, d))
    corners = t.select(F.explode(F.array("a", "b", "c")).alias("cell_id"), "longest").groupBy("cell_id").agg(F.count(F.lit(1)).alias("triangles"), F.max("longest").alias("longest"))
    return B.cells(spark, d).select("cell_id").join(corners, "cell_id", "left").fillna(0, ["triangles"])
