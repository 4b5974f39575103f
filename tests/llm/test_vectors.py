"""Vector search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from histolith.llm import vectors as V

DIM = 64


def near_groups(rng, groups=120, size=4, noise=0.12):
    centres = rng.normal(size=(groups, DIM))
    x = np.repeat(centres, size, axis=0) + noise * rng.normal(size=(groups * size, DIM))
    return x * rng.uniform(0.2, 5, size=(len(x), 1))


def brute(ids, x, k, threshold):
    u = V.unit_rows(x)
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -2)
    out = set()
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-cos[i, j], ids[j]))
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order[:k] if cos[i, j] >= threshold}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v], 0) for i, v in rows], "id long, v array<float>, _code int")


def search(spark, rows, **kw):
    return {(r.a, r.b) for r in V.similar_pairs(frame(spark, rows), "id", "v", dim=DIM, **kw).collect()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = near_groups(rng).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    want = brute(ids, x.astype(float), 5, 0.95)
    got = search(spark, list(zip(ids, x)))
    assert len(want) > 500 and not got - want
    assert len(got & want) >= 0.98 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    base, other = rng.normal(size=DIM).astype(np.float32), rng.normal(size=DIM).astype(np.float32)
    copies = [(i, base * 2 ** (i % 3)) for i in range(40)]
    bad = [(50, None), (51, base[:61]), (52, base * 0), (53, np.append(base[:63], np.nan)), (54, np.append(base[:63], np.inf)), (None, base)]
    got = search(spark, copies + [(60, other), (60, other), (61, other * 4)] + bad)
    want = brute(list(range(40)) + [60, 61], np.vstack([v for _, v in copies] + [other, other * 4]).astype(float), 5, 0.95)
    assert got == want
    assert max(a for a, _ in got if a < 40) < 40 and len(got) <= 41 * 5


def test_empty(spark):
    assert search(spark, []) == set()
    assert search(spark, [(1, np.ones(DIM))]) == set()


def brute_meeting(keys, codes, radius):
    """Pairs that share a bucket in some table and lie within the radius."""
    gap = np.bitwise_count(codes[:, None].view(np.uint64) ^ codes[None].view(np.uint64))
    meet = (keys[:, None, :] == keys[None, :, :]).any(-1) & (gap <= radius)
    return {(i, j) for i, j in zip(*np.nonzero(meet)) if i < j}


@pytest.mark.parametrize(("width", "tables", "first_only"), [(6, 5, True), (13, 9, True), (20, 30, True), (13, 9, False)])
def test_meeting_pairs_are_complete(spark, width, tables, first_only):
    """Every pair of a bucket within the radius is found, by the pigeonhole bound all codes fewer bits apart than there are substrings."""
    rng = np.random.default_rng(width)
    index = V.Index(width, tables, 14)
    base = rng.integers(0, 2, (150, index.bits), dtype=np.uint8)
    flips = np.zeros_like(base)
    for i, row in enumerate(flips):
        row[rng.choice(index.bits, i % (2 * tables), replace=False)] = 1
    bits = np.vstack([base, base ^ flips])
    keys, codes = index.keys(bits), np.packbits(bits[:, :64], axis=1, bitorder="little").view("<i8").ravel()
    rows = [(int(keys[i, j]), i, int(codes[i]), j) for i in range(300) for j in range(tables)]
    pairs = V.meeting_pairs(spark.createDataFrame(rows, "_key long, _id long, _code long, _t int"), index, first_only=first_only).collect()
    got = {(min(r), max(r)) for r in pairs}
    assert got == brute_meeting(keys, codes, 14)
    gap = (bits[:, None] != bits[None]).sum(-1)
    assert {(i, j) for i in range(300) for j in range(i + 1, 300) if gap[i, j] < tables and gap[i, j] <= 14} <= got


@pytest.mark.parametrize("share", [0.1, 0.13])
def test_entries_are_bounded_at_any_size(share):
    """The cost model keeps entries and comparisons of a vector small at a million and at a hundred million rows."""
    flips = (np.random.default_rng(5).random((2_000, 256)) < share).astype(np.uint8)
    plans = {n: V.plan_index(n, flips) for n in (100, 10**4, 10**6, 10**8, 10**9)}
    for n, most in ((10**4, 30), (10**6, 70), (10**8, 200), (10**9, 350)):
        assert plans[n].entries() <= most
        assert plans[n].comparisons(n) <= 40 * most
    for index in plans.values():
        agree = 1 - (1 - (1 - share) ** index.width) ** index.tables
        assert agree >= 0.97 and index.bits >= 64


def test_crowded_buckets_are_cut(spark):
    """A third of the rows are near copies of one vector: buckets are lengthened, equal codes go by blocks."""
    rng = np.random.default_rng(9)
    x = np.vstack([near_groups(rng, groups=60), rng.normal(size=DIM) + 0.05 * rng.normal(size=(120, DIM)), np.ones(DIM) + 1e-5 * rng.normal(size=(120, DIM))])
    ids = rng.permutation(len(x)).tolist()
    want = brute(ids, x, 3, 0.95)
    rows = [(i, [float(a) for a in v]) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.a, r.b) for r in V.similar_pairs(df, "id", "v", dim=DIM, k=3, split_rows=20).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.05 * len(want)


def test_equal_codes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    x = np.ones(DIM) + 1e-3 * rng.normal(size=(70, DIM))
    index, coder = V.Index(8, 4, 14), V.Coder(np.zeros(DIM), np.ones((DIM, 64)))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "_id long, _vec array<double>")
    got = {(min(r), max(r)) for r in V.block_pairs(df, coder, index, DIM, 3, 0.9).collect()}
    assert got >= brute(list(range(70)), x, 3, 0.9)
    assert len(got) <= 70 * 3 * 5


def test_crowded_buckets_lose_no_pair(spark):
    """Pairs that agree in a crowded bucket and in no further bits are found; rows that meet in several such buckets too."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=DIM) + 0.2 * rng.normal(size=(400, DIM))
    index, coder = V.Index(8, 4, 14), V.Coder(np.zeros(DIM), rng.normal(size=(DIM, 64)))
    keys = index.keys(coder.bits(V.unit_rows(x)))
    want = {(i, j) for i, j in brute(list(range(400)), x, 3, 0.95) if (keys[i] == keys[j]).any()}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "_id long, _vec array<double>")
    got = {(r[0], r[1]) for r in V.candidate_pairs(df, coder, index, DIM, 3, 0.95, split_rows=8).collect()}
    assert len(want) > 500 and not want - got


@pytest.mark.parametrize("share", [0.25, 0.45])
def test_tables_have_no_limit(share):
    """Pairs far apart meet with the wanted chance at any size, by as many tables as that takes or in one bucket."""
    flips = (np.random.default_rng(5).random((2_000, 256)) < share).astype(np.uint8)
    p = flips.mean(1)
    for n in (10**4, 10**8, 10**9):
        index = V.plan_index(n, flips)
        assert (1 - (1 - (1 - p) ** index.width) ** index.tables).mean() >= V.MEET - 0.001
