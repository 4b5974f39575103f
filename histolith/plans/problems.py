"""Queries of the general problems: nearby points and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.operators.packed import split_packed
from histolith.operators.proximity import points_in_rings, points_within
from histolith.session import table

DOUBLET_RADIUS = 10.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    doublets = table(spark, d, "doublet_df")
    within = points_within(doublets, table(spark, d, "cell_dobulet_df"), DOUBLET_RADIUS, query_key="doublet_id", point_key="cell_id")
    inside = points_in_rings(doublets, table(spark, d, "cell_boundaries"), point_key="doublet_id", ring_key="cell_id")
    return within.select("doublet_id", "cell_id", F.lit("within").alias("relation")).unionByName(inside.select("doublet_id", "cell_id", F.lit("inside").alias("relation")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "gene_annotation"), "attribute", ["line_no"])


QUERIES = {"p1_found": p1_found, "p5_found": p5_found}

ORACLES = {
    "p1_found": """
with d as (select distinct doublet_id, x, y from doublet_df where isfinite(x) and isfinite(y) and doublet_id is not null),
c as (select distinct cell_id, x, y from cell_dobulet_df where isfinite(x) and isfinite(y) and cell_id is not null),
v as (select cell_id, len(ring) as n, i, ring[i].x as ax, ring[i].y as ay, ring[i % len(ring) + 1].x as bx, ring[i % len(ring) + 1].y as by_
      from (select cell_id, ring, unnest(range(1, len(ring) + 1)) as i from cell_boundaries where len(ring) >= 3)),
box as (select cell_id, min(ax) as x0, max(ax) as x1, min(ay) as y0, max(ay) as y1 from v group by cell_id having bool_and(isfinite(ax) and isfinite(ay))),
near as (select d.doublet_id, d.x, d.y, b.cell_id from d join box b on d.x between b.x0 and b.x1 and d.y between b.y0 and b.y1),
wn as (select doublet_id, cell_id,
         sum(case when ay <= y and by_ > y and (bx - ax) * (y - ay) - (x - ax) * (by_ - ay) > 0 then 1
                  when ay > y and by_ <= y and (bx - ax) * (y - ay) - (x - ax) * (by_ - ay) < 0 then -1 else 0 end) as w
       from near join v using (cell_id) group by doublet_id, cell_id, x, y)
select distinct d.doublet_id, c.cell_id, 'within' as relation from d join c on sqrt((d.x - c.x) * (d.x - c.x) + (d.y - c.y) * (d.y - c.y)) <= 10
union all
select distinct doublet_id, cell_id, 'inside' from wn where w <> 0""",
}
