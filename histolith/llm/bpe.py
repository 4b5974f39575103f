"""Token ids of a whole corpus by a public byte-level BPE vocabulary, in numpy matrices.

Texts are cut by the vocabulary's pattern; the distinct pieces of a batch are merged together.
Pieces of similar length form one padded matrix of token ids. In each round every row
merges its leftmost pair of minimum rank; the rank of a pair is looked up in an open-addressing
hash table held in two arrays. A merge removes one place from each row, so the
matrix is compacted to one column less; rows without a pair left are taken out.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from histolith.session import map_arrow, spread

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Name of the installed module that knows where the vocabulary files are and how texts are cut.
TOKENIZERS = "public_tokenizers"

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
PAD = np.int32(-1)
#: Padded lengths of the matrices, in bytes; longer pieces are merged one by one.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Pieces in one matrix at most, so that its memory is bounded.
MATRIX_CELLS = 2_000_000
#: Pieces a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000
#: Characters of text that are worked on at once.
CHUNK_CHARS = 2_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    return importlib.import_module(TOKENIZERS).path(name)


class Vocabulary:
    """Ranks of byte strings, and the hash table of mergeable pairs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._build(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(merged, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # every free slot takes the first of its keys, the others go on
            free = self.keys[slot] == -1
            taken, first = np.unique(slot[free], return_index=True)
            chosen = todo[free][first]
            self.keys[taken], self.values[taken] = keys[chosen], ranks[chosen]
            placed = np.isin(todo, chosen)
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it does not merge or one is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        out = np.full(flat.shape, NONE, np.int32)
        slot = self._slot(flat)
        found = self.keys[slot]
        hit = found == flat
        out[hit] = self.values[slot[hit]]
        open_ = np.nonzero(~hit & (found != -1) & (flat != -2))[0]
        slot = slot[open_]
        while len(open_):  # the table has free slots, so every chain ends
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == flat[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            open_, slot = open_[go], slot[go]
        return out.reshape(keys.shape)

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of every row of a padded matrix after all merges."""
        done: list[np.ndarray | None] = [None] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                for r, row in zip(rows[over], ids[over]):
                    done[r] = row[row >= 0]
                going = ~over
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                if not len(rows):
                    break
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            if width == 2:
                ranks = np.full((n, 1), NONE, np.int32)
                ids = np.concatenate([ids, np.full((n, 1), PAD, np.int32)], axis=1)
                continue
            keep = np.ones((n, width - 1), bool)
            keep[line, np.minimum(at, width - 2)] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for place in (at - 1, at):
                ok = np.nonzero((place >= 0) & (place < width - 2))[0]
                p = place[ok]
                ranks[ok, p] = self.pair_ranks(ids[ok, p], ids[ok, p + 1])
        return done  # type: ignore[return-value]

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long piece: all places of the minimum pair at once.

        Where such a step would bring up a pair of lower rank, which could have had its
        turn in between, only the leftmost place is merged.
        """
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.nonzero(ranks == best)[0]
            pairs = ids[at].astype(np.int64) << 32 | ids[at + 1]
            at = at[pairs == pairs[0]]
            if len(at) > 1:  # runs of one token pair up from the left
                starts = np.concatenate([[True], np.diff(at) != 1])
                run = np.cumsum(starts) - 1
                at = at[(np.arange(len(at)) - np.nonzero(starts)[0][run]) % 2 == 0]
            for places in (at, at[:1]):
                new = ids.copy()
                new[places] = best
                keep = np.ones(len(ids), bool)
                keep[places + 1] = False
                new = new[keep]
                # Only the pairs beside a merged place are new.
                kept = np.ones(len(ranks), bool)
                kept[places] = False
                new_ranks = ranks[kept]
                moved = places - np.arange(len(places))
                beside = np.unique(np.concatenate([moved - 1, moved]))
                beside = beside[(beside >= 0) & (beside < len(new) - 1)]
                fresh = self.pair_ranks(new[beside], new[beside + 1])
                new_ranks[beside] = fresh
                if len(places) == 1 or not len(fresh) or fresh.min() >= best:
                    break
            ids, ranks = new, new_ranks
        return ids

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, np.ndarray]:
        """Ids of distinct pieces, by length-bucketed matrices."""
        out: dict[str, np.ndarray] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = np.array([whole], np.int32)
            elif len(raw) > WIDTHS[-1]:
                out[piece] = self.merge_long(self.byte_ids[np.frombuffer(raw, np.uint8)])
            else:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(raw)), []).append((piece, raw))
        for width, group in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                flat = np.frombuffer(b"".join(raw for _, raw in part), np.uint8)
                lengths = np.array([len(raw) for _, raw in part])
                ids = np.full((len(part), width), PAD, np.int32)
                ids[np.arange(width) < lengths[:, None]] = self.byte_ids[flat]
                for (piece, _), row in zip(part, self.merge_matrix(ids)):
                    out[piece] = row
        return out


class Encoder:
    """Encodes batches of texts, remembering the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def _groups(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        group, chars = [], 0
        for t in texts:
            group.append(t)
            chars += len(t or "")
            if chars > CHUNK_CHARS:
                yield group
                group, chars = [], 0
        if group:
            yield group

    def encode(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        """One array of ids for every piece of every text, text by text in groups."""
        find = self.vocabulary.pattern.findall
        for group in self._groups(texts):
            cut = [find(t) if t else [] for t in group]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = {p for pieces in cut for p in pieces if p not in self.known}
            if new:
                self.known.update(self.vocabulary.encode_pieces(new))
            known = self.known
            for pieces in cut:
                yield [known[p] for p in pieces]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process, built once."""
    return Encoder(Vocabulary(path, pattern))


def _encode(docs: DataFrame, key: str, text: str, vocabulary: str, counts_only: bool) -> DataFrame:
    module = importlib.import_module(TOKENIZERS)
    path, pattern = module.path(vocabulary), module.PATTERN
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[pa.RecordBatch] = []
            row, flat, sizes, held = 0, [], [], 0

            def flush() -> pa.RecordBatch:
                nonlocal row, flat, sizes, held
                n = len(sizes)
                if counts_only:
                    values: pa.Array = pa.array(np.array(sizes, np.int64))
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), values], names=[key, "value"])
                row, flat, sizes, held = row + n, [], [], 0
                return made

            for arrays in enc.encode(texts):
                size = sum(map(len, arrays))
                sizes.append(size)
                held += size
                if not counts_only:
                    flat.extend(arrays)
                if held > CHUNK_CHARS:
                    out.append(flush())
            if sizes:
                out.append(flush())
            yield from out

    value = "bigint" if counts_only else "array<int>"
    return map_arrow(spread(docs.select(key, text)), run, f"`{key}` {kind}, value {value}")


def encode_documents(docs: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``ids``: the token ids of every text, without special tokens.

    Every row gives one row, repeated ones too. Defined cases: empty and null texts have an
    empty list, never null; a null key is kept; texts of any length are encoded whole; strings
    that look like special tokens are ordinary text; other columns are ignored.
    """
    return _encode(docs, key, text, vocabulary, False).withColumnRenamed("value", "ids")


def count_tokens(docs: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``n_tokens``: the number of token ids of every text; 0 for empty and null texts."""
    return _encode(docs, key, text, vocabulary, True).withColumnRenamed("value", "n_tokens")
