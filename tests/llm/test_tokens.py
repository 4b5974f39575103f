"""Token ids against public tokenizers, and packing against its rules."""

from __future__ import annotations

import base64
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histolith.llm import bpe, packing

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_path(), P.PATTERN))


def ids(encoder, texts):
    return [np.concatenate(a).tolist() if a else [] for a in encoder.encode(texts)]


TEXTS = [
    "", "hello world", "  two  spaces \n\n\tand tabs ", "it's we'll I'd", "日本語のテキスト。" * 40, "Привет, мир!", "👩‍👩‍👧 emoji ​ zero",
    "a" * 3000, "ab" * 2000, "hahaha" * 300 + "!" * 999, "zzzzyyyyzzzz" * 300, "<|endoftext|> is text", "x" * 256 + " " + "x" * 257, "\u0000\u0001 control",
]


def test_fixed_texts(encoder, reference):
    assert ids(encoder, TEXTS) == [reference.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aeinorst .,'0123\n", max_size=400)), max_size=5))
def test_random_texts(encoder, reference, texts):
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_documents_equal_the_other_library(spark, data, encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = [e.ids for e in t.encode_batch([d.text or "" for d in docs], add_special_tokens=False)]
    assert ids(encoder, [d.text for d in docs]) == want
    df = spark.createDataFrame([(d.doc_id, d.text, 1) for d in docs] + [(None, "a b", 2)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df, "doc_id", "text").collect()}
    assert {d.doc_id: w for d, w in zip(docs, want)} == {k: v for k, v in got.items() if k is not None} and got[None] == ids(encoder, ["a b"])[0]
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode_documents(df.limit(0), "doc_id", "text").count() == 0


# packing -----------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(1, 60))
def test_fullest_combination(histogram, room):
    available = sorted(histogram.items(), reverse=True)
    chosen = packing._fullest(available, room)
    reach = {0}
    for size, n in available:
        reach = {r + size * i for r in reach for i in range(n + 1) if r + size * i <= room}
    assert all(chosen[s] <= histogram[s] for s in chosen)
    assert sum(s * n for s, n in chosen.items()) == max(reach)


def test_packing_keeps_all_items_whole(spark):
    rng = np.random.default_rng(6)
    sizes = [int(x) for x in np.minimum(rng.lognormal(3, 1, 800), 500)] + [20] * 700 + [0, 0, None, -3, 100, 101, 350, 1000]
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "id long, n int, container int")
    rows = packing.pack(df, "id", "n", 100, slices=5).collect()
    parts, load = defaultdict(list), defaultdict(int)
    for r in rows:
        parts[r.id].append((r.part, r.start, r.size))
        load[r.container] += r.size
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    for i, s in enumerate(sizes):
        s = max(s or 0, 0)
        assert sum(p[2] for p in parts[i]) == s
        assert len(parts[i]) == max(1, -(-s // 100))  # only what exceeds a container is divided
        assert sorted(parts[i]) == [(k, k * 100, min(100, s - k * 100)) for k in range(len(parts[i]))]
    total = sum(max(s or 0, 0) for s in sizes)
    assert len(load) <= -(-total // 100) * 1.02 + 1


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert packing.pack(df, "id", "n", 10).count() == 0
    zero = spark.createDataFrame([(1, 0), (None, None)], "id long, n int")
    assert {r.container for r in packing.pack(zero, "id", "n", 10).collect()} == {0}
    twins = spark.createDataFrame([(1, 6), (1, 6), (1, 6)], "id long, n int")
    assert sorted(r.container for r in packing.pack(twins, "id", "n", 10).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)
