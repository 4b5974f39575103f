"""Queries over pixels, each with its SQL where that can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.operators import raster as R
from histolith.operators import tabular as T
from histolith.plans.sql import TX, with_
from histolith.sources import bundle as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

COUNTS = "c as (select px, py, count(*) as n from tx group by px, py)"
EXTENT = "e as (select min(px) as x0, max(px) as x1, min(py) as y0, max(py) as y1 from c)"
GRID = "g as (select x0 + i as px, y0 + j as py from e, unnest(range(0, x1 - x0 + 1)) t(i), unnest(range(0, y1 - y0 + 1)) u(j))"
DENSE = "d as (select g.px, g.py, coalesce(n, 0) as v from g left join c on c.px = g.px and c.py = g.py)"


def offsets(radius: int, disk: bool) -> str:
    test = f" where dx * dx + dy * dy <= {radius * radius}" if disk else ""
    return f"o as (select * from (select i as dx from unnest(range(-{radius}, {radius + 1})) t(i)), (select j as dy from unnest(range(-{radius}, {radius + 1})) u(j)){test})"


def reflected(symmetric: bool = False) -> str:
    """Each pixel with the pixels of its window, mirrored at the border."""
    low = "2 * {a}0 - 1 - ({p})" if symmetric else "2 * {a}0 - ({p})"
    high = "2 * {a}1 + 1 - ({p})" if symmetric else "2 * {a}1 - ({p})"
    at = lambda a, p: f"case when {p} < {a}0 then {low.format(a=a, p=p)} when {p} > {a}1 then {high.format(a=a, p=p)} else {p} end"
    return f"""w as (select b.px, b.py, b.dx, b.dy, d.v from (select g.px, g.py, dx, dy, {at("x", "g.px + dx")} as qx, {at("y", "g.py + dy")} as qy from g, o, e) b
  join d on d.px = b.qx and d.py = b.qy)"""


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_(ctes, sql)
        return fn

    return add


def counts(spark: SparkSession, d: str) -> tuple[DataFrame, R.Extent]:
    n = B.transcripts(spark, d).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    return n, R.Extent.of(n)


@query("select px, py, v as n from d", (TX, COUNTS, EXTENT, GRID, DENSE))
def join06_dense_grid(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    return R.dense_grid(n, "n", ex)


@query(
    "select g.px, g.py, coalesce(s, 0)::bigint as density from g left join (select px + dx as px, py + dy as py, sum(n) as s from c, o group by 1, 2) using (px, py)",
    (TX, COUNTS, EXTENT, GRID, offsets(3, True)),
)
def img01_transcript_density(spark: SparkSession, d: str) -> DataFrame:
    """Molecules within 3 pixels of every pixel."""
    n, ex = counts(spark, d)
    return R.stencil(n, "n", ex, R.disk(3), target="density").withColumn("density", F.col("density").cast("long"))


@query(
    "select g.px, g.py, round(coalesce(s, 0), 6) as qv_density from g left join (select px + dx as px, py + dy as py, sum(q) as s from (select px, py, avg(qv) as q from tx where qv is not null group by 1, 2), o group by 1, 2) using (px, py)",
    (TX, COUNTS, EXTENT, GRID, offsets(3, True)),
)
def img02_quality_density(spark: SparkSession, d: str) -> DataFrame:
    t = B.transcripts(spark, d)
    ex = R.Extent.of(t)
    q = t.where(F.col("qv").isNotNull()).groupBy("px", "py").agg(F.avg("qv").alias("q"))
    return R.stencil(q, "q", ex, R.disk(3), target="s").select("px", "py", F.round("s", 6).alias("qv_density"))


@query(
    """select g.px, g.py, round(coalesce(a, 0) * coalesce(b, 0), 6) as ambient from g left join (select px + dx as px, py + dy as py, sum(m) as a, sum(k) as b from (
    select px, py, max(coalesce(morans_i, 0)) as m, max(case when highly_variable then 1.0 when not highly_variable then 0.5 else 0 end) as k from tx left join gene_panel using (gene) group by 1, 2), o group by 1, 2) using (px, py)""",
    (TX, COUNTS, EXTENT, GRID, offsets(3, True)),
)
def img03_ambient_density(spark: SparkSession, d: str) -> DataFrame:
    """Product of two disk sums of per-pixel maxima, of a global and of a local gene score."""
    g = B.genes(spark, d).select("gene", "morans_i", F.when(F.col("highly_variable"), 1.0).otherwise(0.5).alias("local"))
    t = B.transcripts(spark, d)
    ex = R.Extent.of(t)
    m = t.join(g, "gene", "left").groupBy("px", "py").agg(F.max(F.coalesce("morans_i", F.lit(0.0))).alias("m"), F.max(F.coalesce("local", F.lit(0.0))).alias("k"))
    both = R.stencil(m, "m", ex, R.disk(3), target="a").join(R.stencil(m, "k", ex, R.disk(3), target="b"), ["px", "py"])
    return both.select("px", "py", F.round(F.col("a") * F.col("b"), 6).alias("ambient"))


GAUSS = "k as (select dx, dy, exp(-0.5 * (dx * dx + dy * dy)) / (select pow(sum(exp(-0.5 * i * i)), 2) from unnest(range(-5, 6)) t(i)) as wt from o)"


@query(
    "select w.px, w.py, round(log10(sum(wt * v * v) + 1), 6) as energy from w join k using (dx, dy) group by 1, 2",
    (TX, COUNTS, EXTENT, GRID, DENSE, offsets(5, False), reflected(True), GAUSS),
)
def img04_energy(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    return R.pixel_metric(n, "n", ex, "energy").select("px", "py", F.round("energy", 6).alias("energy"))


@query(
    """select px, py, round(log10(sqrt(gx * gx + gy * gy) + 1), 6) as edge from (select px, py, sum(v * dx * (2 - abs(dy))) as gx, sum(v * dy * (2 - abs(dx))) as gy from w group by 1, 2)""",
    (TX, COUNTS, EXTENT, GRID, DENSE, offsets(1, False), reflected()),
)
def img05_edge_strength(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    return R.pixel_metric(n, "n", ex, "edge").select("px", "py", F.round("edge", 6).alias("edge"))


BLUR = """bl as (select px, py, floor(sum(v * wx * wy) / 256.0 + 0.5)::bigint as b from (select *, case abs(dx) when 0 then 6 when 1 then 4 else 1 end as wx, case abs(dy) when 0 then 6 when 1 then 4 else 1 end as wy from w) group by 1, 2)"""
OTSU = """h as (select b as gv, count(*) as n from bl group by 1), p as (select gv, sum(n) over (order by gv) as w0, sum(gv * n) over (order by gv) as s0, sum(n) over () as w, sum(gv * n) over () as s from h),
t as (select gv as threshold from p order by coalesce(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 0) desc, gv limit 1)"""


@query("select px, py, case when b > threshold then 1 else 0 end as relevance from bl, t", (TX, COUNTS, EXTENT, GRID, DENSE, offsets(2, False), reflected(), BLUR, OTSU))
def img06_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Blurred counts above the Otsu threshold."""
    from histolith.session import materialize

    n, ex = counts(spark, d)
    b = materialize(R.pixel_metric(n, "n", ex, "blur"), "blur")
    return T.one_row(b, R.otsu_threshold(b, "blur")).select("px", "py", (F.col("blur") > F.col("threshold")).cast("int").alias("relevance"))


@query(
    """select px, py, round(-sum(p * ln(p)), 6) + 0.0 as entropy, round(ln(25) + sum(p * ln(p)), 6) as uniformity from (select px, py, v, count(*) / 25.0::double as p from w group by 1, 2, 3) group by 1, 2""",
    (TX, COUNTS, EXTENT, GRID, DENSE, offsets(2, False), reflected()),
)
def img07_entropy_uniformity(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    t = R.pixel_metric(n, "n", ex, "texture")
    return t.select("px", "py", (F.round("entropy", 6) + 0.0).alias("entropy"), F.round("uniformity", 6).alias("uniformity"))


@query(
    """select w.px, w.py, round(avg(1.0 / (1 + abs(w.v - d.v))), 6) as homogeneity from w join d on d.px = w.px and d.py = w.py where not (dx = 0 and dy = 0) group by 1, 2""",
    (TX, COUNTS, EXTENT, GRID, DENSE, offsets(2, False), reflected()),
)
def img08_homogeneity(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    return R.pixel_metric(n, "n", ex, "texture").select("px", "py", F.round("homogeneity", 6).alias("homogeneity"))


@query()
def img10_local_binary_pattern(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    return R.pixel_metric(n, "n", ex, "lbp").withColumn("lbp", F.col("lbp").cast("int"))


@query(
    "select px, py, round(log2((v + 1) / (select midpoint from m)), 6) as snr from d",
    (
        TX, COUNTS, EXTENT, GRID, DENSE,
        """m as (select round_even(lo + (bin + 0.5) * (hi - lo) / 100, 3) as midpoint from (select bin, count(*) as n, any_value(lo) as lo, any_value(hi) as hi from (
        select least(floor((v - lo) / (hi - lo)::double * 100), 99)::int as bin, lo, hi from d, (select min(v) as lo, max(v) as hi from d)) group by bin) order by n desc, bin limit 1)""",
    ),
)
def img11_intensity_snr(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    v = R.dense_grid(n, "n", ex)
    return T.one_row(v, T.mode_midpoint(v, "n")).select("px", "py", F.round(F.log2((F.col("n") + 1) / F.col("midpoint")), 6).alias("snr"))


def _spread(a: np.ndarray) -> dict[str, np.ndarray]:
    w = R.windows(a, 1)
    return {"spread": w.max(-1) - w.min(-1)}


@query(
    "select px, py, (max(v) - min(v))::double as spread from w group by 1, 2",
    (TX, COUNTS, EXTENT, GRID, DENSE, offsets(1, False), reflected()),
)
def img12_custom_window(spark: SparkSession, d: str) -> DataFrame:
    """A window function registered by the user."""
    R.register_window("spread", _spread, ["spread"], 1)
    n, ex = counts(spark, d)
    return R.pixel_metric(n, "n", ex, "spread")


@query(
    """select round(-regr_slope(ln(boxes), ln(k)), 6) as dimension from (select k, count(*) as boxes from (select distinct k, x // k as bx, y // k as by_ from (
    select px - x0 as x, py - y0 as y, side from c, e, s where px - x0 < side and py - y0 < side), s2) group by k)""",
    (TX, COUNTS, EXTENT, "s as (select pow(2, floor(log2(least(x1 - x0 + 1, y1 - y0 + 1))))::bigint as side from e)", "s2 as (select unnest([pow(2, i)::bigint for i in range(2, log2(side)::bigint + 1)]) as k from s)"),
)
def img13_fractal_dimension(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    return R.box_counting_dimension(n, ex).select(F.round("dimension", 6).alias("dimension"))


@query(
    "select distinct px + dx as px, py + dy as py from c, o, e where n >= 3 and px + dx between x0 and x1 and py + dy between y0 and y1",
    (TX, COUNTS, EXTENT, offsets(2, True)),
)
def img14_dilation(spark: SparkSession, d: str) -> DataFrame:
    n, ex = counts(spark, d)
    mask = n.where(F.col("n") >= 3).select("px", "py", F.lit(1).alias("m"))
    return R.window_map(mask, "m", ex, R.dilate(2), ["mask"], radius=2).where(F.col("mask") > 0).select("px", "py")


@query(
    "select g.px, g.py, round(coalesce(s, 0), 6) as density from g left join (select px + dx as px, py + dy as py, sum(n * wt) as s from c, k group by 1, 2) using (px, py)",
    (TX, COUNTS, EXTENT, GRID, offsets(5, False), GAUSS),
)
def agg38_density_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Two-dimensional histogram of the molecules, smoothed by a Gaussian."""
    n, ex = counts(spark, d)
    return R.stencil(n, "n", ex, R.gaussian(1.0, 5), target="s").select("px", "py", F.round("s", 6).alias("density"))


@query(
    "select g.px, g.py, coalesce(s, 0)::bigint as box_sum from g left join (select px + dx as px, py + dy as py, sum(n) as s from c, o group by 1, 2) using (px, py)",
    (TX, COUNTS, EXTENT, GRID, offsets(2, False)),
)
def agg39_box_sum(spark: SparkSession, d: str) -> DataFrame:
    """Molecules in the square window around every pixel."""
    n, ex = counts(spark, d)
    box = {(i, j): 1.0 for i in range(-2, 3) for j in range(-2, 3)}
    return R.stencil(n, "n", ex, box, target="s").select("px", "py", F.col("s").cast("long").alias("box_sum"))
