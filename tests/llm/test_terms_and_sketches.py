"""Term counts and percentile sketches against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from histolith.llm import sketches as S
from histolith.llm import terms as T


def test_counts_with_a_hot_term(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(50)) for _ in range(900)] + [(rng.choice("abcdef"), rng.randrange(20)) for _ in range(500)]
    rows += [("a", None)] * 7 + [(None, 3)] * 5 + [("only", None)]
    df = spark.createDataFrame([(t, r, 1) for t, r in rows], "t string, r long, records int")
    occurrences, records = defaultdict(int), defaultdict(set)
    for t, r in rows:
        if t is not None:
            occurrences[t] += 1
            records[t] |= set() if r is None else {r}
    for slices in (1, 7, 64):
        got = {x.term: (x.occurrences, x.records) for x in T.term_frequencies(df, "t", "r", slices=slices).collect()}
        assert got == {t: (n, len(records[t])) for t, n in occurrences.items()}
    assert T.distinct_records(df, "r").first().total == 50
    assert T.term_frequencies(df.limit(0), "t", "r").count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([("a", 4, 4), ("b", 5, 61), ("c", 5, 60), ("d", 3, 90)], "term string, occurrences long, records long")
    total = spark.createDataFrame([(100,)], "total long")
    got = {(r.term, r.mark) for r in T.mark_terms(counts, total, rare_below=5, common_above=0.6).collect()}
    assert got == {("a", "rare"), ("b", "common"), ("d", "rare"), ("d", "common")}


def groups(seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(60):
        n = int(rng.integers(1, 60)) if g % 3 else int(rng.integers(200, 4000))
        shift = float(rng.normal(20, 1.0)) if g % 2 else 20.0
        v = np.round(rng.normal(shift, 3, n), 1 if g % 5 else 0)
        out += [(g, float(x)) for x in v] + [(g, None), (g, float("nan"))]
    return out


def test_percentile_tests_are_exact(spark):
    rows = groups()
    df = spark.createDataFrame([(g, 1, v, v) for g, v in rows], "g int, d int, v double, w double")
    tests = [("v", 0.5, "<", 20.0), ("w", 0.9, ">", 24.0)]
    got = {(r.g, r.measure) for r in S.percentile_tests(df, ["g", "d"], tests, least=20, k=200).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            by[g].append(v)
    want = {(g, "v") for g, v in by.items() if len(v) >= 20 and np.quantile(v, 0.5) < 20}
    want |= {(g, "w") for g, v in by.items() if len(v) >= 20 and np.quantile(v, 0.9) > 24}
    assert got == want and len(want) > 10


def test_merged_sketches_keep_the_error_bound(spark):
    rng = np.random.default_rng(5)
    v = rng.exponential(10, 30_000)
    df = spark.createDataFrame([("x", i % 7, float(a)) for i, a in enumerate(v)] + [("empty", 0, None)], "g string, day int, v double")
    merged = S.merge(S.sketch(df, ["g", "day"], ["v"]), ["g"], ["v"])
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    got = S.quantiles(merged, ["g"], ["v"], shares).collect()
    assert {r.g for r in got} == {"x"} and len(got) == len(shares)
    for r in got:
        assert r.n == 30_000 and abs((v <= r.estimate).mean() - r.share) <= 3 * r.rank_error


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert S.percentile_tests(df, ["g"], [("v", 0.5, "<", 1.0)]).count() == 0
