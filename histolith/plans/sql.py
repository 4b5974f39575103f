"""Common table expressions of the DuckDB statements."""

from __future__ import annotations

BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(12288)"

TX = f"""tx as (select transcript_id, x, y, case when isnan(z) then null else z end as z, gene, cell_id, case when isnan(qv) then null else qv end as qv, overlaps_nucleus,
  trunc(x)::int as px, trunc(y)::int as py from (
  select *, coalesce(nullif(trim(feature_name, {BLANKS}), ''), 'NaN') as gene, row_number() over (partition by transcript_id order by ingested_at desc nulls last) as rk
  from (select * replace (coalesce(cell_id, -1) as cell_id) from transcripts where transcript_id is not null)) where rk = 1)"""
CELLS = """cells as (select distinct cell_id, sample, celltype, x, y, case when isnan(cell_area) then null else cell_area end as cell_area,
  case when isnan(nucleus_area) then null else nucleus_area end as nucleus_area, transcript_counts, control_probe_counts, control_codeword_counts, leiden from cell_table where cell_id is not null)"""
EXPR = "expr as (select cell_id, gene, count(*) as n from tx where cell_id <> -1 and gene <> 'NaN' group by 1, 2)"
LABELS = """labels as (select regexp_extract(barcode, '^cell_([0-9]+)$', 1)::bigint as cell_id, min(regexp_replace(cluster, '[^A-Za-z0-9]', '', 'g')) as label from annotation
  where regexp_matches(barcode, '^cell_[0-9]+$') and regexp_replace(cluster, '[^A-Za-z0-9]', '', 'g') <> '' group by 1)"""
RINGS = "rings as (select cell_id, ring from cell_boundaries where len(ring) >= 3 and list_bool_and([coalesce(not isnan(v.x) and not isnan(v.y), false) for v in ring]))"
EDGES = """edges as (select cell_id, len(ring) as n, i, ring[i].x as ax, ring[i].y as ay, ring[i % len(ring) + 1].x as bx, ring[i % len(ring) + 1].y as by_
  from (select cell_id, ring, unnest(range(1, len(ring) + 1)) as i from rings))"""


def with_(ctes: tuple[str, ...], body: str) -> str:
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
