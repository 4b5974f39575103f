"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(12288)"

LATEST = f"""
latest as (
  select * exclude (rk) from (
    select transcript_id, run_day, qv, z, cell_id,
           nullif(nullif(trim(feature_name, {BLANKS}), ''), 'NaN') as feature_name,
           row_number() over (partition by transcript_id order by ingested_at desc nulls last) as rk
    from transcripts where transcript_id is not null)
  where rk = 1)"""

COUNTS = f"""
{LATEST},
names as (select feature_name as term, transcript_id, case when cell_id <> -1 then cell_id end as cell from latest),
labels as (select * from (select regexp_replace(cluster, '[^A-Za-z0-9]', '', 'g') as term, barcode from annotation) where term <> '')"""

ORACLES = {
    "p2_found": """
with ok as (select cell_id, min(x_vec) as v from cell_table
            where len(x_vec) = 64 and list_bool_and([isfinite(e) for e in x_vec]) and list_bool_or([e <> 0 for e in x_vec]) group by cell_id),
s as (select a.cell_id as a, b.cell_id as b, list_cosine_similarity(a.v::double[], b.v::double[]) as c from ok a, ok b where a.cell_id <> b.cell_id),
r as (select a, b, c, row_number() over (partition by a order by round(c, 9) desc, b) as rk from s)
select distinct least(a, b) as cell_id_a, greatest(a, b) as cell_id_b from r where rk <= 5 and c >= 0.95""",
    "p3_counts": f"""
with {COUNTS}
select 'feature_name' as field, term, count(*) as occurrences, count(distinct cell) as records from names where term is not null group by term
union all
select 'cluster', term, count(*), count(distinct barcode) from labels group by term""",
    "p3_found": f"""
with {COUNTS},
f as (select term, count(distinct transcript_id) as n, count(distinct cell) as c from names where term is not null group by term),
l as (select term, count(distinct barcode) as n from labels group by term),
ft as (select count(distinct cell) as total from names), lt as (select count(distinct barcode) as total from labels)
select 'feature_name' as field, term, 'rare' as mark from f where n < 5
union all select 'feature_name', term, 'common' from f, ft where c > 0.6 * total
union all select 'cluster', term, 'rare' from l where n < 5
union all select 'cluster', term, 'common' from l, lt where n > 0.2 * total""",
    "p4_found": f"""
with {LATEST}
select feature_name, run_day, 'qv' as measure from latest
where feature_name is not null and qv is not null and not isnan(qv)
group by feature_name, run_day having count(*) >= 20 and quantile_cont(qv, 0.5) < 20
union all
select feature_name, run_day, 'z' from latest
where feature_name is not null and z is not null and not isnan(z)
group by feature_name, run_day having count(*) >= 20 and quantile_cont(z, 0.9) > 30""",
    "p9_counts": r"""
with d as (select doc_id, replace(replace(coalesce(text, ''), chr(13)||chr(10), chr(10)), chr(13), chr(10)) as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\s\x0b\p{Z}]+'), lambda x: x <> '') as tokens,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\x0b\p{Z}]')) as lines,
             list_filter(regexp_split_to_array(lower(regexp_replace(t, '([\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}])', '\1 ', 'g')), '[^\p{L}\p{M}’'']+'), lambda x: x <> '') as terms
      from d),
c as (select list(distinct lower(word)) as words from common_words),
n as (select doc_id, t, tokens, lines, terms, len(array_to_string(tokens, '')) as solid, len(tokens) as n_words, len(terms) as n_terms, len(list_filter(terms, lambda x: list_contains(words, x))) as known from w, c)
select doc_id, case when n_words > 0 then len(t)::double else 0 end as n_chars, n_words::double as n_words, len(lines)::double as n_lines,
       case when n_words > 0 then round(solid / n_words, 9) else 0 end as mean_word_length,
       case when n_words > 0 then round(len(regexp_replace(t, '[^\p{L}]+', '', 'g')) / solid, 9) else 0 end as letter_ratio,
       case when n_words > 0 then round(len(regexp_replace(t, '[^\p{N}]+', '', 'g')) / solid, 9) else 0 end as digit_ratio,
       case when n_terms > 0 then round(known / n_terms, 9) else 0 end as common_share,
       len(list_distinct(terms))::double as distinct_terms
from n""",
    "p8_loads": "select count(*) as posts, 0 as overfull, 0 as misplaced, true as without_gaps, true as nearly_full from documents",
}
