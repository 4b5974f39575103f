"""Mixture groups on made vectors, text statistics and rules on made texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from histolith.llm import clusters as C
from histolith.llm import quality as Q

DIM = 64


def group_rows(sizes, noise_rows, seed=7):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0][: len(sizes)]
    rows, truth = [], []
    for g, n in enumerate(sizes):
        for _ in range(n):
            v = 0.72 * centres[g] + 0.69 * rng.normal(size=DIM) / np.sqrt(DIM)
            rows.append(v * rng.uniform(0.5, 4))
            truth.append(g)
    for _ in range(noise_rows):
        rows.append(rng.normal(size=DIM))
        truth.append(-1)
    return rows, truth


def test_groups_are_found(spark):
    rows, truth = group_rows([600, 400, 250, 120], 40)
    table = [(i, [float(a) for a in v], "x") for i, v in enumerate(rows)] + [(9001, None, "x"), (9002, [0.0] * DIM, "x"), (9003, [1.0] * 3, "x"), (0, [float(a) for a in rows[0]], "x")]
    df = spark.createDataFrame(table, "id long, v array<float>, group string")
    got = {r.id: r.group for r in C.similarity_groups(df, "id", "v", dim=DIM).collect()}
    assert all(got.get(i, -1) == t for i, t in enumerate(truth) if t >= 0) or sum(got.get(i, -1) == t for i, t in enumerate(truth)) >= 0.99 * len(truth)
    assert not {9001, 9002, 9003} & set(got)
    labels = spark.createDataFrame([(i, None if i == 5 else "z" if i == 9 else f"c{t}") for i, t in enumerate(truth)], "id long, label string")
    groups = spark.createDataFrame([(i, g, 0.0) for i, g in got.items()], "id long, group int, density double")
    found = {(r.id, r.group_label) for r in C.label_conflicts(groups, labels, "id", "label").collect()}
    assert {(5, "c0"), (9, "c0")} <= found
    described = {r.group: (r.size, len(r.typical)) for r in C.describe_groups(groups, "id").collect()}
    assert described[0][1] == 5 and sum(n for n, _ in described.values()) == len(got)


def purity(spark, groups, noise, dim):
    """Groups found, and the share of planted records that have the group most of their own have."""
    rng = np.random.default_rng(3)
    rows, truth = [rng.normal(size=(noise, dim))], [-1] * noise
    for g, n in enumerate(groups):
        c = rng.normal(size=dim)
        rows.append(0.72 * c / np.linalg.norm(c) + 0.69 * rng.normal(size=(n, dim)) / np.sqrt(dim))
        truth += [g] * n
    table = pa.table({"id": pa.array(np.arange(len(truth))), "v": pa.array([v.tolist() for v in np.vstack(rows)])})
    got = {r.id: r.group for r in C.similarity_groups(spark.createDataFrame(table), "id", "v", dim=dim).collect()}
    right = [0] * len(groups)
    for g in range(len(groups)):
        found = [got[i] for i, t in enumerate(truth) if t == g and i in got]
        right[g] = max((found.count(x) for x in set(found)), default=0)
    return len(set(got.values())), sum(right) / sum(groups), sum(truth[i] < 0 for i in got), min(right)


def test_more_groups_than_components_of_the_mixture(spark):
    n, share, extra, least = purity(spark, [30] * 90, 200, 96)
    assert n == 90 and share >= 0.97 and extra <= 10 and least >= 20


def test_groups_too_rare_for_the_sample(spark):
    n, share, extra, least = purity(spark, [9_000, 6_000, 14, 14, 14], 5_000, 64)
    assert n == 5 and share >= 0.97 and extra <= 50 and least >= 10


def test_candidates_come_from_all_rows(spark, monkeypatch):
    """Groups too rare for a sample of thousands have components from the start, and every candidate is fitted over all rows."""
    seen = []
    fit = C.fit_mixture
    monkeypatch.setattr(C, "fit_mixture", lambda features, candidates, *rest: seen.append((features.count(), candidates)) or fit(features, candidates, *rest))
    n, share, extra, least = purity(spark, [6_000, 4_000, 14, 14, 14], 2_000, 64)
    assert n == 5 and share >= 0.97 and extra <= 20 and least >= 10
    rows, candidates = seen[0]
    assert rows == 12_042 and sorted({len(m.weights) - 1 for m in candidates}) == [2, 3, 4, 5]
    assert all(sum(len(m.weights) == k and m.spherical == s for m in candidates) == 1 for k in (3, 4, 5, 6) for s in (True, False))


def test_too_few_rows_for_groups(spark):
    df = spark.createDataFrame([(1, [1.0] * DIM), (2, [-1.0] * DIM)], "id long, v array<float>")
    assert C.similarity_groups(df, "id", "v", dim=DIM).count() == 0
    assert C.similarity_groups(df.limit(0), "id", "v", dim=DIM).count() == 0


def test_tree_sum(spark):
    df = spark.range(0, 1000, 1, 150).selectExpr("cast(id as double) as v")
    total = C.tree_sum(df, lambda batches: np.array([sum(float(np.asarray(b.column(0)).sum()) for b in batches)]))
    assert total[0] == 499500


WORDS = ["the", "is", "a", "of", "and"]


def stats(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.asDict() for r in Q.document_statistics(df, "doc_id", "text", WORDS).orderBy("doc_id").collect()]


def test_statistics(spark):
    prose, items, cells, blank, none = stats(spark, "The cell is red. A map of\nthe grid (old)!", "- a b\n- c\n\n2) d e", "a\tb\tc\r\n1\t2\t3", " \n ", None)
    assert prose["n_words"] == 10 and prose["n_lines"] == 2 and prose["line_end_share"] == 0.5
    assert prose["common_share"] == pytest.approx(5 / 10) and prose["stop_rate"] == pytest.approx(0.2)
    assert prose["mean_word_length"] == pytest.approx(sum(map(len, "The cell is red. A map of the grid (old)!".split())) / 10)
    assert items["bullet_share"] == 1 and items["short_line_share"] == 1 and items["n_lines"] == 3
    assert cells["cell_line_share"] == 1 and cells["n_lines"] == 2
    assert all(v == 0 for s in (blank, none) for k, v in s.items() if k != "doc_id")


def test_long_and_odd_texts(spark):
    a, b, c = stats(spark, "test " * 50_000, "これは核です。それは台です。", "ÃÂ â€™ " * 30)
    assert a["distinct_terms"] == 1 and a["n_words"] == 50_000
    assert b["cjk_ratio"] > 0.8 and b["stop_rate"] > 0
    assert c["foreign_ratio"] > 0.8


def plain_statistics(t):
    """Some statistics of one text by patterns, one after another."""
    import re

    import regex

    t = (t or "").replace("\r\n", "\n").replace("\r", "\n")
    lines = [s for s in (regex.sub(r"^[\s\p{Z}]+|[\s\p{Z}]+$", "", x) for x in t.split("\n")) if s]
    tokens = [w for w in regex.split(r"[\s\p{Z}]+", t) if w]
    ends = [bool(re.search(r"[.!?。！？…][\"'”’»)\]]*$", s)) for s in lines]
    bullet = [bool(re.match(r"(?:[-*•·+–]|\[[ xX]?\]|\(?[0-9]{1,3}[.)\]]|\(?[a-zA-Z][.)])\s+\S", s)) for s in lines]
    cells = [
        s.count("\t") >= 2 or s.count("|") >= 2 or len(re.findall(r";(?=\S)", s)) >= 3 or len(re.findall(r",(?=\S)", s)) >= 3 or len(re.findall(r" {3,}(?=\S)", s)) >= 2 or len(re.findall("</t[dh]>", s)) >= 2
        for s in lines
    ]
    solid = sum(map(len, tokens))
    return {
        "n_words": len(tokens), "n_lines": len(lines), "line_end_share": np.mean(ends), "bullet_share": np.mean(bullet), "cell_line_share": np.mean(cells), "distinct_line_share": len(set(lines)) / len(lines),
        "letter_ratio": len(regex.findall(r"\p{L}", t)) / solid, "digit_ratio": len(regex.findall(r"\p{N}", t)) / solid, "longest_word": max(map(len, tokens)),
        "repeat_rate": sum(len(m[0]) for m in re.finditer(r"(\S)\1{3,}", t)) / solid, "short_line_share": np.mean([len(s.split()) <= 7 and not e for s, e in zip(lines, ends)]),
        "bullet_chars": sum(len(s) for s, b in zip(lines, bullet) if b) / sum(map(len, lines)),
    }


def test_statistics_equal_patterns(spark):
    """Arrays of code points against one pattern per statistic, over odd pieces in random order and across chunks."""
    rng = np.random.default_rng(6)
    pieces = ["- a", "[ ] b c", "[x] d", "(12) e", "3. f", "a) g", "*", "x\ty\tz", "1;2;3;4", "a, b, c", "p|q|r", "u   v   w", "</td></th>", "end.", 'end?"', "。漢字", "aaaa", "....", "\u00a0", "\u3000x", "", " ", "\r", "é", "🎉ok", "12", "(", "[", "1234. z"]
    texts = ["\n".join(" ".join(rng.choice(pieces, rng.integers(1, 4))) for _ in range(rng.integers(1, 6))) for _ in range(400)]
    texts = [t for t in texts if t.strip(" \r\n\u00a0\u3000")]
    for got, t in zip(stats(spark, *texts), texts):
        want = plain_statistics(t)
        assert {k: round(got[k], 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}, t


def made_corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = "cell map grid stain pixel lens tray focus signal edge probe table".split()
    out = []
    for i in range(n):
        kind = ("prose", "prose", "prose", "list", "table", "junk")[i % 6]
        if kind == "prose":
            text = " ".join(f"The {rng.choice(words)} is a part of the {rng.choice(words)}." for _ in range(rng.integers(1, 9)))
        elif kind == "list":
            text = "\n".join(f"- {rng.choice(words)} {rng.choice(words)}" for _ in range(rng.integers(4, 20)))
        elif kind == "table":
            text = "\n".join("\t".join(str(x) for x in rng.integers(0, 999, 5)) for _ in range(rng.integers(4, 20)))
        else:
            text = " ".join(["qrtzx", "bcdfgh", "lol", "0f", "a7"][int(rng.integers(0, 5))] * 2 for _ in range(rng.integers(20, 60)))
        out.append((i, text, kind))
    return out


def test_rules_hold_on_unseen_documents(spark):
    train, test = made_corpus(300, 1), made_corpus(120, 2)
    docs = spark.createDataFrame(train, "doc_id int, text string, truth string")
    flipped = [(i, "list" if i % 41 == 0 else k, "ra") for i, _, k in train] + [(None, "junk", "rb")]
    rules = Q.fit_rules(docs, spark.createDataFrame(flipped, "doc_id int, label string, rater string"), "doc_id", "text", "label", WORDS)
    new = spark.createDataFrame(test + [(900, "[deleted]", ""), (901, None, ""), (902, "  ", "")], "doc_id int, text string, kind string")
    got = {r.doc_id: r.kind for r in Q.classify(new, "doc_id", "text", rules, WORDS).collect()}
    assert not {900, 901, 902} & set(got)
    assert np.mean([got[i] == k for i, _, k in test]) >= 0.95
    assert "prose" not in {r.kind for r in Q.classify(new, "doc_id", "text", rules, WORDS, without="prose").collect()}


def test_rules_without_labels(spark):
    docs = spark.createDataFrame(made_corpus(6, 1), "doc_id int, text string, truth string")
    rules = Q.fit_rules(docs, spark.createDataFrame([], "doc_id int, label string"), "doc_id", "text", "label", WORDS)
    assert rules == [] and {r.kind for r in Q.classify(docs, "doc_id", "text", rules, WORDS).collect()} == {"prose"}


def test_majority_of_raters(spark):
    df = spark.createDataFrame([(1, "junk"), (1, "list"), (1, "list"), (2, "table"), (2, "list"), (3, None)], "doc_id int, label string")
    assert {(r.doc_id, r.label) for r in Q.majority_labels(df, "doc_id", "label").collect()} == {(1, "list"), (2, "list")}
