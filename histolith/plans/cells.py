"""Queries over cells, genes and molecules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histolith.operators import tabular as T
from histolith.plans.sql import CELLS, EXPR, LABELS, TX, with_
from histolith.sources import bundle as B

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


# projections -----------------------------------------------------------------------------------


@query("select cell_id, round(transcript_counts / nullif(cell_area, 0), 6) as canorm_transcript_counts from cells", (CELLS,))
def proj01_area_normalised(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).select("cell_id", r6(T.share(F.col("transcript_counts"), F.col("cell_area"))).alias("canorm_transcript_counts"))


@query("select cell_id, coalesce(cell_area, 0.0) as cell_area, coalesce(nucleus_area, 0.0) as nucleus_area, coalesce(transcript_counts, 0) as transcript_counts from cells", (CELLS,))
def proj02_fill_missing(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).select("cell_id", "cell_area", "nucleus_area", "transcript_counts").fillna(0)


@query("select cell_id, round(log10(transcript_counts + 1), 6) as log_counts from cells", (CELLS,))
def proj03_log_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).select("cell_id", r6(F.log10(F.col("transcript_counts") + 1)).alias("log_counts"))


@query(
    "select px, py, round(log2((n + 1) / 2.0), 6) as snr from (select px, py, count(*) as n from tx group by px, py)",
    (TX,),
)
def proj04_signal_to_noise(spark: SparkSession, d: str) -> DataFrame:
    n = B.transcripts(spark, d).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    return n.select("px", "py", r6(F.log2((F.col("n") + 1) / F.lit(2.0))).alias("snr"))


@query(
    "select cell_id, round((cell_area - lo) / nullif(hi - lo, 0), 6) as scaled from cells, (select min(cell_area) as lo, max(cell_area) as hi from cells)",
    (CELLS,),
)
def proj05_min_max(spark: SparkSession, d: str) -> DataFrame:
    return T.min_max(B.cells(spark, d), "cell_area", "scaled").select("cell_id", r6("scaled").alias("scaled"))


@query(
    "select cell_id, round(x - 500 + (select abs(least(min(x - 500), 0)) from cells), 6) as shifted from cells",
    (CELLS,),
)
def proj06_shift_non_negative(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d).withColumn("v", F.col("x") - 500)
    return T.shift_non_negative(c, "v", "shifted").select("cell_id", r6("shifted").alias("shifted"))


@query(
    "select cell_id, case when scaled > 0.5 then 1 else 0 end as mask from (select cell_id, (cell_area - lo) / nullif(hi - lo, 0) as scaled from cells, (select min(cell_area) as lo, max(cell_area) as hi from cells)) where scaled is not null",
    (CELLS,),
)
def proj08_mask(spark: SparkSession, d: str) -> DataFrame:
    scaled = T.min_max(B.cells(spark, d), "cell_area", "scaled").where(F.col("scaled").isNotNull())
    return scaled.select("cell_id", (F.col("scaled") > 0.5).cast("int").alias("mask"))


@query(
    """select cell_id, coalesce(a < 0.45, false) as area_filtered_out, coalesce(t < 0.45, false) as counts_filtered_out,
    coalesce(a < 0.45, false) or coalesce(t < 0.45, false) as hqr_filtered_out from (
    select cell_id, (cell_area - a0) / nullif(a1 - a0, 0) as a, (transcript_counts - t0) / nullif(cast(t1 - t0 as double), 0) as t
    from cells, (select min(cell_area) as a0, max(cell_area) as a1, min(transcript_counts) as t0, max(transcript_counts) as t1 from cells))""",
    (CELLS,),
)
def proj09_belief_filter(spark: SparkSession, d: str) -> DataFrame:
    c = T.min_max(T.min_max(B.cells(spark, d), "cell_area", "a"), "transcript_counts", "t")
    low = lambda n: F.coalesce(F.col(n) < 0.45, F.lit(False))
    return c.select("cell_id", low("a").alias("area_filtered_out"), low("t").alias("counts_filtered_out"), (low("a") | low("t")).alias("hqr_filtered_out"))


@query("select gene, gene like 'MT-%' as mt_flag, (gene like 'RPS%' or gene like 'RPL%') as ribo_flag from gene_panel")
def proj10_gene_flags(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("gene")
    return B.genes(spark, d).select("gene", g.startswith("MT-").alias("mt_flag"), (g.startswith("RPS") | g.startswith("RPL")).alias("ribo_flag"))


@query("select gene, count(*) as n from tx where regexp_matches(gene, '^NegControlCodeword') group by gene", (TX,))
def proj11_negative_probes(spark: SparkSession, d: str) -> DataFrame:
    return B.transcripts(spark, d).where(F.col("gene").rlike("^NegControlCodeword")).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("select transcript_id, cell_id, qv from tx where qv < 20 and cell_id <> -1", (TX,))
def proj12_low_quality(spark: SparkSession, d: str) -> DataFrame:
    return B.transcripts(spark, d).where((F.col("qv") < 20) & (F.col("cell_id") != -1)).select("transcript_id", "cell_id", "qv")


@query("select transcript_id, x, y from tx where x between 120 and 180 and y between 110 and 190", (TX,))
def proj13_crop(spark: SparkSession, d: str) -> DataFrame:
    t = B.transcripts(spark, d)
    return t.where(F.col("x").between(120, 180) & F.col("y").between(110, 190)).select("transcript_id", "x", "y")


@query(
    "select case when cell_id = -1 then 'outside' when overlaps_nucleus = 1 then 'nucleus' else 'cytoplasm' end as location, count(*) as n from tx group by 1",
    (TX,),
)
def proj14_location_class(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("cell_id") == -1, "outside").when(F.col("overlaps_nucleus") == 1, "nucleus").otherwise("cytoplasm")
    return B.transcripts(spark, d).groupBy(place.alias("location")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select gene, coalesce(case when mt then 'mitochondrial' when ribo then 'ribosomal' when mt is not null then 'coding' end, 'Unknown') as biotype, count(*) as n
    from tx left join gene_panel using (gene) group by 1, 2""",
    (TX,),
)
def proj15_biotype_lookup(spark: SparkSession, d: str) -> DataFrame:
    kinds = B.genes(spark, d).select("gene", F.when(F.col("mt"), "mitochondrial").when(F.col("ribo"), "ribosomal").otherwise("coding").alias("biotype"))
    counts = B.transcripts(spark, d).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(kinds, "gene", "left").select("gene", F.coalesce("biotype", F.lit("Unknown")).alias("biotype"), "n")


@query(
    """select cell_id, case when nucleus_area is null or nucleus_area = 0 then 'nucleus_free'
      when control_codeword_counts > 0 and cell_area > (select avg(cell_area) from cells) then 'doublet'
      when control_probe_counts > 0 then 'doublet' else 'none' end as artefact from cells""",
    (CELLS,),
)
def proj16_artefact_class(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d)
    c = T.one_row(c, c.agg(F.avg("cell_area").alias("_mean")))
    kind = (
        F.when(F.col("nucleus_area").isNull() | (F.col("nucleus_area") == 0), "nucleus_free")
        .when((F.col("control_codeword_counts") > 0) & (F.col("cell_area") > F.col("_mean")), "doublet")
        .when(F.col("control_probe_counts") > 0, "doublet")
        .otherwise("none")
    )
    return c.select("cell_id", kind.alias("artefact"))


@query("select cell_id, celltype from (select *, count(*) over (partition by celltype, sample) as n from cells) where n > 20", (CELLS,))
def proj17_min_group_size(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("celltype", "sample"))
    return B.cells(spark, d).withColumn("_n", n).where(F.col("_n") > 20).select("cell_id", "celltype")


@query(
    """select cell_id, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) as distance from cells, (select avg(x) as mx, avg(y) as my from cells)""",
    (CELLS,),
)
def proj18_distance_to_centre(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d)
    c = T.one_row(c, c.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    return c.select("cell_id", r6(F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))).alias("distance"))


@query(
    "select px, py, cast(floor(255.0 * (n - lo) / nullif(hi - lo, 0)) as int) as v from (select px, py, count(*) as n from tx group by px, py), (select min(n) as lo, max(n) as hi from (select count(*) as n from tx group by px, py))",
    (TX,),
)
def proj19_uint8(spark: SparkSession, d: str) -> DataFrame:
    n = B.transcripts(spark, d).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    n = T.one_row(n, n.agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    return n.select("px", "py", F.floor(F.try_divide(255.0 * (F.col("n") - F.col("lo")), (F.col("hi") - F.col("lo")).cast("double"))).cast("int").alias("v"))


# joins by key ----------------------------------------------------------------------------------

DENSE = "dense as (select cell_id, row_number() over (order by cell_id) - 1 as dense_id from cells)"


@query("select transcript_id, coalesce(dense_id, -1) as dense_cell from tx left join dense using (cell_id)", (TX, CELLS, DENSE))
def join01_dense_cell_ids(spark: SparkSession, d: str) -> DataFrame:
    from histolith.operators.numbering import dense_ids

    return B.transcripts(spark, d).join(dense_ids(B.cells(spark, d), "cell_id", "dense_id"), "cell_id", "left").select("transcript_id", F.coalesce("dense_id", F.lit(-1)).alias("dense_cell"))


@query(
    "select cell_id, coalesce(n, 0) as low_qv from cells left join (select cell_id, count(*) as n from tx where qv < 20 and cell_id <> -1 group by cell_id) using (cell_id)",
    (TX, CELLS),
)
def join02_low_quality_per_cell(spark: SparkSession, d: str) -> DataFrame:
    n = B.transcripts(spark, d).where((F.col("qv") < 20) & (F.col("cell_id") != -1)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("low_qv"))
    return B.cells(spark, d).select("cell_id").join(n, "cell_id", "left").fillna(0, ["low_qv"])


@query(
    """select c.cell_id, e.total, l.label, c.cell_area from cells c left join (select cell_id, sum(n)::bigint as total from expr group by 1) e using (cell_id) left join labels l using (cell_id)""",
    (TX, CELLS, EXPR, LABELS),
)
def join03_metric_chain(spark: SparkSession, d: str) -> DataFrame:
    total = B.expression(B.transcripts(spark, d)).groupBy("cell_id").agg(F.sum("n").alias("total"))
    return B.cells(spark, d).select("cell_id", "cell_area").join(total, "cell_id", "left").join(B.annotation(spark, d), "cell_id", "left")


@query("select t.transcript_id, e.n from tx t left join expr e on t.cell_id = e.cell_id and t.gene = e.gene", (TX, EXPR))
def join04_gather_by_cell_and_gene(spark: SparkSession, d: str) -> DataFrame:
    t = B.transcripts(spark, d)
    return t.select("transcript_id", "cell_id", "gene").join(B.expression(t), ["cell_id", "gene"], "left").select("transcript_id", "n")


@query("select transcript_id, coalesce(morans_i, 0) as ambient from tx left join gene_panel using (gene)", (TX,))
def join05_gene_score(spark: SparkSession, d: str) -> DataFrame:
    score = B.genes(spark, d).select("gene", B.number(F.col("morans_i")).alias("ambient"))
    return B.transcripts(spark, d).join(score, "gene", "left").select("transcript_id", F.coalesce("ambient", F.lit(0.0)).alias("ambient"))


@query(
    "select t.transcript_id, round(p.share, 6) as p_cluster from tx t join (select leiden, count(*) / (select count(*) from cells)::double as share from cells group by leiden) p on p.leiden = (select c.leiden from cells c where c.cell_id = t.cell_id)",
    (TX, CELLS),
)
def join07_cluster_probability(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d)
    p = T.one_row(c.groupBy("leiden").agg(F.count(F.lit(1)).alias("n")), c.agg(F.count(F.lit(1)).alias("total"))).select("leiden", r6(F.col("n") / F.col("total")).alias("p_cluster"))
    return B.transcripts(spark, d).join(c.select("cell_id", "leiden").join(p, "leiden"), "cell_id").select("transcript_id", "p_cluster")


@query(
    "select gene, count(*) as n from tx where gene in (select gene from gene_panel where highly_variable) group by gene",
    (TX,),
)
def join17_existence_filter(spark: SparkSession, d: str) -> DataFrame:
    hv = B.genes(spark, d).where("highly_variable").select("gene")
    return B.transcripts(spark, d).join(hv, "gene", "left_semi").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct gene from tx where gene not in (select gene from gene_panel where gene is not null)", (TX,))
def join18_not_on_panel(spark: SparkSession, d: str) -> DataFrame:
    return B.transcripts(spark, d).select("gene").distinct().join(B.genes(spark, d).select("gene"), "gene", "left_anti")


# aggregations ----------------------------------------------------------------------------------


@query("select px, py, count(*) as n from tx group by px, py", (TX,))
def agg01_count_per_pixel(spark: SparkSession, d: str) -> DataFrame:
    return B.transcripts(spark, d).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


@query("select px, py, round(avg(qv), 9) as qv from tx where qv is not null group by px, py", (TX,))
def agg02_mean_quality_per_pixel(spark: SparkSession, d: str) -> DataFrame:
    return B.transcripts(spark, d).where(F.col("qv").isNotNull()).groupBy("px", "py").agg(r6(F.avg("qv"), 9).alias("qv"))


@query("select px, py, max(coalesce(morans_i, 0)) as ambient from tx left join gene_panel using (gene) group by px, py", (TX,))
def agg03_max_score_per_pixel(spark: SparkSession, d: str) -> DataFrame:
    t = B.transcripts(spark, d).join(B.genes(spark, d).select("gene", "morans_i"), "gene", "left")
    return t.groupBy("px", "py").agg(F.max(F.coalesce("morans_i", F.lit(0.0))).alias("ambient"))


@query(
    "select leiden, round(avg(cell_area), 6) as area, round(avg(nucleus_area), 6) as nucleus, round(avg(transcript_counts), 6) as counts from cells group by leiden",
    (CELLS,),
)
def agg04_means_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("leiden").agg(r6(F.avg("cell_area")).alias("area"), r6(F.avg("nucleus_area")).alias("nucleus"), r6(F.avg("transcript_counts")).alias("counts"))


@query(
    """select cell_id, control_probe_counts + control_codeword_counts + transcript_counts as s_score, round(cell_area - nucleus_area, 6) as as_score from cells""",
    (CELLS,),
)
def agg05_row_scores(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).select(
        "cell_id", (F.col("control_probe_counts") + F.col("control_codeword_counts") + F.col("transcript_counts")).alias("s_score"), r6(F.col("cell_area") - F.col("nucleus_area")).alias("as_score")
    )


@query("select leiden, round_even(avg(transcript_counts) - avg(cell_area), 2) as cluster_score from cells group by leiden", (CELLS,))
def agg06_cluster_score(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("leiden").agg(F.bround(F.avg("transcript_counts") - F.avg("cell_area"), 2).alias("cluster_score"))


@query(
    "select celltype, count(*) filter (control_probe_counts > 0) as low_class, count(*) filter (control_probe_counts = 0) as high_class from cells group by celltype",
    (CELLS,),
)
def agg07_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("celltype").agg(F.count_if(F.col("control_probe_counts") > 0).alias("low_class"), F.count_if(F.col("control_probe_counts") == 0).alias("high_class"))


@query("select sample, celltype, round(100.0 * count(*) / sum(count(*)) over (partition by sample), 6) as pct from cells group by sample, celltype", (CELLS,))
def agg08_percentage_in_group(spark: SparkSession, d: str) -> DataFrame:
    f = T.group_fraction(B.cells(spark, d), "sample", "celltype")
    return f.select("sample", "celltype", r6(100.0 * F.col("fraction")).alias("pct"))


@query(
    """select s.sample, t.leiden, coalesce(n, 0) as n, round(coalesce(n / sum(n) over (partition by s.sample), 0), 6) as fraction
    from (select distinct sample from cells) s cross join (select distinct leiden from cells where leiden is not null) t
    left join (select sample, leiden, count(*) as n from cells where leiden is not null group by 1, 2) g on g.sample = s.sample and g.leiden = t.leiden""",
    (CELLS,),
)
def agg09_dense_fractions(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d).where(F.col("leiden").isNotNull())
    return T.dense_group_fraction(c, "sample", "leiden").select("sample", "leiden", "n", r6("fraction").alias("fraction"))


@query(
    "select leiden, round(median(cell_area), 6) as cell_area, round(median(nucleus_area), 6) as nucleus_area, round(median(transcript_counts), 6) as transcript_counts, round(median(x), 6) as x, round(median(y), 6) as y from cells group by leiden",
    (CELLS,),
)
def agg10_median_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("leiden").agg(*[r6(F.median(c)).alias(c) for c in ("cell_area", "nucleus_area", "transcript_counts", "x", "y")])


@query("select leiden, round(100 * avg(case when transcript_counts > 40 then 1.0 else 0.0 end), 6) as pct_above from cells group by leiden", (CELLS,))
def agg11_percent_above(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("leiden").agg(r6(100 * F.avg(F.when(F.col("transcript_counts") > 40, 1.0).otherwise(0.0))).alias("pct_above"))


@query("select celltype, round(100 * avg(case when control_probe_counts > 0 then 1.0 else 0.0 end), 6) as pct_flagged from cells group by celltype", (CELLS,))
def agg12_flag_share(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("celltype").agg(r6(100 * F.avg(F.when(F.col("control_probe_counts") > 0, 1.0).otherwise(0.0))).alias("pct_flagged"))


@query(
    """select celltype, round(quantile_cont(cell_area, 0.25), 6) as q25, round(quantile_cont(cell_area, 0.5), 6) as q50, round(quantile_cont(cell_area, 0.75), 6) as q75,
    round(quantile_cont(cell_area, 0.9), 6) as q90 from cells group by celltype""",
    (CELLS,),
)
def agg13_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = [0.25, 0.5, 0.75, 0.9]
    p = B.cells(spark, d).groupBy("celltype").agg(F.percentile("cell_area", F.array(*map(F.lit, q))).alias("p"))
    return p.select("celltype", *[r6(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("q25", "q50", "q75", "q90"))])


@query(
    """select celltype, round(m, 6) as median, round(mad, 6) as mad, round(m - mad, 6) as low, round(m + mad, 6) as high from (
    select celltype, m, median(abs(transcript_counts - m)) as mad from (select *, median(transcript_counts) over (partition by celltype) as m from cells where celltype is not null) group by celltype, m)""",
    (CELLS,),
)
def agg14_median_mad(spark: SparkSession, d: str) -> DataFrame:
    m = T.median_mad(B.cells(spark, d).where(F.col("celltype").isNotNull()), "transcript_counts", ["celltype"])
    return m.select("celltype", *[r6(c).alias(c) for c in ("median", "mad", "low", "high")])


@query(
    """select bin, count(*) as n from (select least(floor((cell_area - lo) / (hi - lo) * 50), 49)::int as bin from cells, (select min(cell_area) as lo, max(cell_area) as hi from cells) where cell_area is not null) group by bin""",
    (CELLS,),
)
def agg15_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.histogram(B.cells(spark, d), "cell_area", 50).select("bin", "n")


@query(
    """select round_even(lo + (bin + 0.5) * (hi - lo) / 100, 3) as midpoint from (select bin, count(*) as n, any_value(lo) as lo, any_value(hi) as hi from (
    select least(floor((cell_area - lo) / (hi - lo) * 100), 99)::int as bin, lo, hi from cells, (select min(cell_area) as lo, max(cell_area) as hi from cells) where cell_area is not null) group by bin) order by n desc, bin limit 1""",
    (CELLS,),
)
def agg16_background_level(spark: SparkSession, d: str) -> DataFrame:
    return T.mode_midpoint(B.cells(spark, d), "cell_area")


@query(
    """select round(sum((coalesce(p, 0) + 1e-10) * ln((coalesce(p, 0) + 1e-10) / (coalesce(q, 0) + 1e-10))), 6) as divergence from range(100) g(bin)
    left join (select bin, p from h where celltype = 'Stroma') using (bin) left join (select bin, p as q from h where celltype = 'Tubule') using (bin)""",
    (
        CELLS,
        """h as (select celltype, bin, n / (sum(n) over (partition by celltype) * (hi - lo) / 100) as p from (select celltype, bin, lo, hi, count(*) as n from (
        select celltype, lo, hi, least(floor((cell_area - lo) / (hi - lo) * 100), 99)::bigint as bin from cells join (select celltype, min(cell_area) as lo, max(cell_area) as hi from cells group by 1) using (celltype)
        where cell_area is not null and celltype in ('Stroma', 'Tubule')) group by all))""",
    ),
)
def agg17_density_divergence(spark: SparkSession, d: str) -> DataFrame:
    return T.density_divergence(B.cells(spark, d), "cell_area", "celltype", "Stroma", "Tubule").select(r6("divergence").alias("divergence"))


@query(
    "select celltype, round(corr(cell_area, transcript_counts), 6) as r, count(*) as n from cells where cell_area is not null and transcript_counts is not null group by celltype having count(*) > 10",
    (CELLS,),
)
def agg18_correlation(spark: SparkSession, d: str) -> DataFrame:
    return T.pearson(B.cells(spark, d), "cell_area", "transcript_counts", ["celltype"], 10).select("celltype", r6("r").alias("r"), "n")


@query(
    "select round(100.0 * sum(control_probe_counts) / sum(transcript_counts), 6) as control_probe_pct, round(100.0 * sum(control_codeword_counts) / sum(transcript_counts), 6) as control_codeword_pct from cells",
    (CELLS,),
)
def agg19_control_percentages(spark: SparkSession, d: str) -> DataFrame:
    pct = lambda c: r6(100.0 * T.share(F.sum(c), F.sum("transcript_counts")))
    return B.cells(spark, d).agg(pct("control_probe_counts").alias("control_probe_pct"), pct("control_codeword_counts").alias("control_codeword_pct"))


@query(
    """select cell_id, sum(n)::bigint as total_counts, count(*) as n_genes, round(100.0 * sum(case when gene like 'MT-%' and on_panel then n else 0 end) / sum(n), 6) as pct_mt,
    round(100.0 * sum(case when (gene like 'RPS%' or gene like 'RPL%') and on_panel then n else 0 end) / sum(n), 6) as pct_ribo,
    round(100.0 * sum(case when rk <= 10 then n else 0 end) / sum(n), 6) as pct_top_10, round(100.0 * sum(case when rk <= 20 then n else 0 end) / sum(n), 6) as pct_top_20,
    round(100.0 * sum(case when rk <= 50 then n else 0 end) / sum(n), 6) as pct_top_50, round(100.0 * sum(case when rk <= 150 then n else 0 end) / sum(n), 6) as pct_top_150
    from (select e.*, g.gene is not null as on_panel, row_number() over (partition by cell_id order by n desc, e.gene) as rk from expr e left join gene_panel g on e.gene = g.gene) group by cell_id""",
    (TX, EXPR),
)
def agg20_cell_quality(spark: SparkSession, d: str) -> DataFrame:
    q = T.cell_qc(B.expression(B.transcripts(spark, d)), B.genes(spark, d))
    return q.select("cell_id", "total_counts", "n_genes", *[r6(c).alias(c) for c in q.columns if c.startswith("pct_")])


@query(
    """select gene, coalesce(n, 0) as n_cells from (select gene from gene_panel where gene is not null union select gene from expr) left join (select gene, count(*) as n from expr group by gene) using (gene)
    where coalesce(n, 0) <= (select least(100, ceil(0.01 * count(distinct cell_id))) from cells)""",
    (TX, EXPR, CELLS),
)
def agg21_rare_genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes, of the panel or counted, that are in no more cells than 100 or one in a hundred of all cells; those in none included."""
    n = B.expression(B.transcripts(spark, d)).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    names = B.genes(spark, d).select("gene").where(F.col("gene").isNotNull()).union(n.select("gene")).distinct()
    limit = B.cells(spark, d).agg(F.least(F.lit(100.0), F.ceil(F.count_distinct("cell_id") * 0.01)).alias("_limit"))
    found = names.join(n, "gene", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n_cells"))
    return T.one_row(found, limit).where(F.col("n_cells") <= F.col("_limit")).select("gene", "n_cells")


@query()
def agg22_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return T.bootstrap_means(B.cells(spark, d).where(F.col("celltype").isNotNull()).select("celltype", "cell_id", "cell_area"), "celltype", "cell_area")


@query(
    "select sample, bool_and(coalesce(cell_area > 0, false)) as all_valid from cells group by sample",
    (CELLS,),
)
def agg23_all_valid(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).groupBy("sample").agg(F.bool_and(F.coalesce(F.col("cell_area") > 0, F.lit(False))).alias("all_valid"))


@query(
    """select leiden, case when good / nullif(bad, 0)::double > 1 or bad = 0 then case when good > 50 then 'hqcr' else 'small_hqcr' end else 'lqcr' end as region from (
    select leiden, count(*) filter (control_probe_counts = 0) as good, count(*) filter (control_probe_counts > 0) as bad from cells where leiden is not null group by leiden)""",
    (CELLS,),
)
def agg26_region_label(spark: SparkSession, d: str) -> DataFrame:
    g = B.cells(spark, d).where(F.col("leiden").isNotNull()).groupBy("leiden").agg(F.count_if(F.col("control_probe_counts") == 0).alias("good"), F.count_if(F.col("control_probe_counts") > 0).alias("bad"))
    ratio = F.coalesce(T.share(F.col("good"), F.col("bad")), F.lit(100.0))
    return g.select("leiden", F.when(ratio > 1, F.when(F.col("good") > 50, "hqcr").otherwise("small_hqcr")).otherwise("lqcr").alias("region"))


@query("select leiden as bad_cluster from (select leiden, avg(transcript_counts) as m from cells where leiden is not null group by leiden) order by m, leiden limit 1", (CELLS,))
def agg27_lowest_cluster(spark: SparkSession, d: str) -> DataFrame:
    m = B.cells(spark, d).where(F.col("leiden").isNotNull()).groupBy("leiden").agg(F.avg("transcript_counts").alias("m"))
    return m.agg(F.min_by("leiden", F.struct("m", "leiden")).alias("bad_cluster"))


@query("select celltype as largest from (select celltype, count(*) as n from cells where celltype is not null group by celltype) order by n desc, celltype limit 1", (CELLS,))
def agg28_largest_category(spark: SparkSession, d: str) -> DataFrame:
    n = B.cells(spark, d).where(F.col("celltype").isNotNull()).groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "celltype").limit(1).select(F.col("celltype").alias("largest"))


@query("select cell_id, sum(m) > 5 as class, sum(m)::bigint as pixels from (select distinct cell_id, px, py, 1 as m from tx where cell_id <> -1) group by cell_id", (TX,))
def agg29_pixels_to_cell_class(spark: SparkSession, d: str) -> DataFrame:
    p = B.transcripts(spark, d).where(F.col("cell_id") != -1).select("cell_id", "px", "py").distinct()
    return p.groupBy("cell_id").agg((F.count(F.lit(1)) > 5).alias("class"), F.count(F.lit(1)).alias("pixels"))


@query(
    """select cell_id, sum(c) / (4000.0 * count(c))::double as mean, coalesce(sum(c) filter (c <> 0) / (4000.0 * count(c) filter (c <> 0))::double, 0) as mean_nonzero,
    coalesce(sum(c) filter (c > 800) / (4000.0 * count(c) filter (c > 800))::double, 0) as mean_informative
    from (select cell_id, round(qv * 100)::bigint as c from tx where cell_id <> -1) group by cell_id""",
    (TX,),
)
def agg30_pixels_to_cell_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean, mean of non-zero and mean of values above 0.2 of qv / 40; sums are of whole hundredths and thus exact."""
    v = B.transcripts(spark, d).where(F.col("cell_id") != -1).select("cell_id", F.round(F.col("qv") * 100).cast("long").alias("c"))

    def mean(test) -> Column:
        kept = F.when(test, F.col("c"))
        return T.share(F.sum(kept), F.count(kept) * 4000.0)

    zero = F.lit(0.0)
    return v.groupBy("cell_id").agg(
        mean(F.col("c").isNotNull()).alias("mean"), F.coalesce(mean(F.col("c") != 0), zero).alias("mean_nonzero"), F.coalesce(mean(F.col("c") > 800), zero).alias("mean_informative")
    )


MASKS = "masks as (select cell_id, case when transcript_counts > 40 then 1 else 0 end as m1, case when cell_area > 80 then 1 else 0 end as m2, case when nucleus_area > 30 then 1 else 0 end as m3 from cells)"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    above = lambda c, t, n: F.when(F.col(c) > t, 1).otherwise(0).alias(n)
    return B.cells(spark, d).select("cell_id", above("transcript_counts", 40, "m1"), above("cell_area", 80, "m2"), above("nucleus_area", 30, "m3"))


@query(
    """select a.m as m1, b.m as m2, c.m as m3, round(coalesce(n, 0) / (select count(*) from masks)::double, 3) as fraction from (values (0), (1)) a(m), (values (0), (1)) b(m), (values (0), (1)) c(m)
    left join (select m1, m2, m3, count(*) as n from masks group by all) g on g.m1 = a.m and g.m2 = b.m and g.m3 = c.m""",
    (CELLS, MASKS),
)
def agg32_venn(spark: SparkSession, d: str) -> DataFrame:
    return T.three_set_venn(_masks(spark, d), "m1", "m2", "m3")


@query("select cell_id, m1 + m2 + m3 as mask_sum, round((m1 + m2 + m3) / 3.0, 6) as mean_belief from masks", (CELLS, MASKS))
def agg33_mask_sum(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("m1") + F.col("m2") + F.col("m3")
    return _masks(spark, d).select("cell_id", s.alias("mask_sum"), r6(s / 3.0).alias("mean_belief"))


@query("select feature, count(*) as n from gene_annotation group by feature")
def agg34_value_counts(spark: SparkSession, d: str) -> DataFrame:
    from histolith.session import table

    return table(spark, d, "gene_annotation").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("select round(2 * avg(sqrt(cell_area / pi())), 6) as mean_diameter from cells", (CELLS,))
def agg35_mean_diameter(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).agg(r6(2 * F.avg(F.sqrt(F.col("cell_area") / F.pi()))).alias("mean_diameter"))


MARKER_IN_OUT = """select celltype, gene, round(inside, 6) as mean_in, round(outside, 6) as mean_out, round(log2((inside + 1e-9) / (outside + 1e-9)), 6) as log2_ratio from (
  select t.celltype, g.gene, coalesce(s.n, 0) / t.n_in::double as inside, (a.n - coalesce(s.n, 0)) / nullif(total - t.n_in, 0)::double as outside
  from (select celltype, count(*) as n_in from cells where celltype is not null group by 1) t cross join (select gene from gene_panel where highly_variable) g
  cross join (select count(*) as total from cells where celltype is not null)
  join (select gene, sum(n) as n from expr join cells using (cell_id) where celltype is not null group by 1) a on a.gene = g.gene
  left join (select celltype, gene, sum(n) as n from expr join cells using (cell_id) group by 1, 2) s on s.celltype = t.celltype and s.gene = g.gene)"""


@query(MARKER_IN_OUT, (TX, CELLS, EXPR))
def agg36_marker_in_out(spark: SparkSession, d: str) -> DataFrame:
    """Mean expression of each variable gene inside and outside each cell type; zeros count."""
    c = B.cells(spark, d).where(F.col("celltype").isNotNull()).select("cell_id", "celltype")
    hv = B.genes(spark, d).where("highly_variable").select("gene")
    e = B.expression(B.transcripts(spark, d)).join(hv, "gene", "left_semi").join(c, "cell_id")
    by = e.groupBy("celltype", "gene").agg(F.sum("n").alias("n"))
    overall = by.groupBy("gene").agg(F.sum("n").alias("all"))
    sizes = T.one_row(c.groupBy("celltype").agg(F.count(F.lit(1)).alias("n_in")), c.agg(F.count(F.lit(1)).alias("total")))
    grid = sizes.crossJoin(overall).join(by, ["celltype", "gene"], "left").fillna(0, ["n"])  # cell types x panel genes
    grid = grid.withColumn("i", F.col("n") / F.col("n_in")).withColumn("o", T.share(F.col("all") - F.col("n"), F.col("total") - F.col("n_in")))
    return grid.select("celltype", "gene", r6("i").alias("mean_in"), r6("o").alias("mean_out"), r6(F.log2((F.col("i") + 1e-9) / (F.col("o") + 1e-9))).alias("log2_ratio"))


@query("select coalesce(celltype, 'all') as celltype, count(*) as n from cells where celltype is not null group by grouping sets ((celltype), ())", (CELLS,))
def agg40_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d).where(F.col("celltype").isNotNull())
    return c.rollup("celltype").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("celltype", F.lit("all")).alias("celltype"), "n")


# windows, sorts, sets ---------------------------------------------------------------------------


@query("select sample, celltype, n, round(n / sum(n) over (partition by sample), 6) as part from (select sample, celltype, count(*) as n from cells group by 1, 2)", (CELLS,))
def win01_partition_share(spark: SparkSession, d: str) -> DataFrame:
    return T.group_fraction(B.cells(spark, d), "sample", "celltype").select("sample", "celltype", "n", r6("fraction").alias("part"))


@query("select leiden, n, sum(n) over (order by n desc, leiden rows unbounded preceding)::bigint as running from (select leiden, count(*) as n from cells where leiden is not null group by 1)", (CELLS,))
def win02_cumulative(spark: SparkSession, d: str) -> DataFrame:
    n = B.cells(spark, d).where(F.col("leiden").isNotNull()).groupBy("leiden").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), "leiden").rowsBetween(Window.unboundedPreceding, 0)  # clusters, not cells
    return n.withColumn("running", F.sum("n").over(w))


@query(
    """select leiden, case when r < n // 3 then 'low' when r < 2 * n // 3 then 'mid' else 'high' end as level from (
    select leiden, row_number() over (order by m, leiden) - 1 as r, count(*) over () as n from (select leiden, avg(transcript_counts) as m from cells where leiden is not null group by 1))""",
    (CELLS,),
)
def win03_thirds(spark: SparkSession, d: str) -> DataFrame:
    m = B.cells(spark, d).where(F.col("leiden").isNotNull()).groupBy("leiden").agg(F.avg("transcript_counts").alias("m"))
    return T.thirds(m, "leiden", "m").select("leiden", "level")


@query("select cell_id, gene, n from (select *, row_number() over (partition by cell_id order by n desc, gene) as rk from expr) where rk <= 3", (TX, EXPR))
def win04_top_genes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cell_id").orderBy(F.col("n").desc(), "gene")
    return B.expression(B.transcripts(spark, d)).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3).select("cell_id", "gene", "n")


@query("select run_day, n, (sum(n) over (order by run_day) - n)::bigint as offset_rows from (select run_day, count(*) as n from transcripts group by run_day)")
def win05_partition_offsets(spark: SparkSession, d: str) -> DataFrame:
    from histolith.session import table

    n = table(spark, d, "transcripts").groupBy("run_day").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("offset_rows", F.sum("n").over(Window.orderBy("run_day")) - F.col("n"))


@query("select gene, morans_i from gene_panel where morans_i is not null order by morans_i desc, gene")
def sort01_genes_by_score(spark: SparkSession, d: str) -> DataFrame:
    return B.genes(spark, d).where(F.col("morans_i").isNotNull()).select("gene", "morans_i").orderBy(F.col("morans_i").desc(), "gene")


@query("select leiden, count(*) as n from cells where regexp_matches(leiden, '^[0-9]+$') group by leiden", (CELLS,))
def sort02_numeric_order(spark: SparkSession, d: str) -> DataFrame:
    n = B.cells(spark, d).where(F.col("leiden").rlike("^[0-9]+$")).groupBy("leiden").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("leiden").cast("int"))


@query()
def sort03_random_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 10,000 random cells, the same for a given table."""
    return B.cells(spark, d).orderBy(F.xxhash64("cell_id", F.lit(123))).limit(10_000).select("cell_id")


@query("select cell_id, cell_area from cells where cell_area is not null order by cell_area desc, cell_id limit 10", (CELLS,))
def sort04_top_cells(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).where(F.col("cell_area").isNotNull()).orderBy(F.col("cell_area").desc(), "cell_id").limit(10).select("cell_id", "cell_area")


@query("select transcript_id from (select transcript_id, row_number() over (partition by floor(z / 5) order by transcript_id) as r from tx where z is not null) where r % 100 = 1", (TX,))
def sort05_stride_by_depth(spark: SparkSession, d: str) -> DataFrame:
    from histolith.operators.numbering import numbered

    t = B.transcripts(spark, d).where(F.col("z").isNotNull()).select("transcript_id", F.floor(F.col("z") / 5).alias("band"))
    return numbered(t, ["band"], "transcript_id", "r").where(F.col("r") % 100 == 1).select("transcript_id")


@query("select 'all' as celltype, cell_id from cells union all select celltype, cell_id from cells where celltype is not null", (CELLS,))
def set01_union_all(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(spark, d)
    return c.select(F.lit("all").alias("celltype"), "cell_id").unionByName(c.where(F.col("celltype").isNotNull()).select("celltype", "cell_id"))


@query("select gene from gene_panel where highly_variable intersect select gene from tx", (TX,))
def set02_intersect(spark: SparkSession, d: str) -> DataFrame:
    return B.genes(spark, d).where("highly_variable").select("gene").intersect(B.transcripts(spark, d).select("gene"))


@query("select gene from gene_panel except select gene from gene_panel where mt or ribo")
def set03_except(spark: SparkSession, d: str) -> DataFrame:
    g = B.genes(spark, d)
    return g.select("gene").subtract(g.where(F.col("mt") | F.col("ribo")).select("gene"))


@query("select distinct celltype, sample from cells", (CELLS,))
def set04_distinct(spark: SparkSession, d: str) -> DataFrame:
    return B.cells(spark, d).select("celltype", "sample").distinct()


@query(
    """select cell_id, upper(replace(coalesce(celltype, 'none'), ' ', '_')) as tag, regexp_extract(sample, '([a-z]+)$', 1) as slide, split_part(sample, '_', 1) as prefix,
    round(ln(cell_area), 6) as ln_area, round(exp(-cell_area / 100), 6) as decay, ceil(cell_area)::bigint as up, floor(cell_area)::bigint as down,
    round(exp(-0.5 * ((cell_area - 80) / 25) * ((cell_area - 80) / 25)) / (25 * sqrt(2 * pi())), 9) as pdf from cells where cell_area is not null""",
    (CELLS,),
)
def proj20_scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("cell_area")
    z = (a - 80) / 25
    return B.cells(spark, d).where(a.isNotNull()).select(
        "cell_id",
        F.upper(F.replace(F.coalesce("celltype", F.lit("none")), F.lit(" "), F.lit("_"))).alias("tag"),
        F.regexp_extract("sample", "([a-z]+)$", 1).alias("slide"),
        F.get(F.split("sample", "_"), F.lit(0)).alias("prefix"),
        r6(F.ln(a)).alias("ln_area"),
        r6(F.exp(-a / 100)).alias("decay"),
        F.ceil(a).alias("up"),
        F.floor(a).alias("down"),
        F.round(F.exp(-0.5 * z * z) / (25 * F.sqrt(2 * F.pi())), 9).alias("pdf"),
    )
