"""Most similar vectors for every vector, by multi-index hashing.

Vectors are centred, whitened on principal axes and turned by learned rotations (iterative
quantisation), so that signs give balanced bits whose Hamming distance follows the angle. The
code is as long as the search needs: it is cut into m substrings of w bits, and every code is
filed under each of its substrings. By the pigeonhole principle two codes fewer than m bits
apart agree in a whole substring, so these are all found; w and m are chosen by a cost model
(entries and comparisons a row) such that pairs at the threshold, which are simulated on the
sample, meet with the wanted probability. The entries of a vector grow like a small power of the number
of rows (``plan_index``). What meets and lies within the Hamming radius of the first 64
bits is reranked by the cosine of the float vectors.

All pairs of a crowded bucket are compared too, by the float vectors and block by block; each block
gives only the k best of each row, so no table of all pairs is ever written and no bucket larger than a
few times ``SPLIT_ROWS`` reaches a task. That is quadratic in the rows of such a bucket.

Exact copies (a third of all rows is assumed possible) are one class before any of this;
their links among each other follow from the class and are never joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histolith.session import map_arrow, materialize, ship_package

#: Bits of the code that travel with an entry for the check of the Hamming radius.
BITS = 64
#: The rotation is fitted on at most this many vectors, chosen by the hash of their id.
SAMPLE_ROWS = 20_000
#: Rows of the sample on which the rotations are turned, after whitening on all of it.
ROTATION_ROWS = 8_000
#: Vectors of that sample on which pairs at the threshold are simulated.
TRIAL_ROWS = 4_000
#: Unit vectors equal to this many decimals are copies of each other.
COPY_DECIMALS = 6
#: Chance with which a pair at just the threshold meets in a substring, and lies within the Hamming radius.
MEET, WITHIN = 0.98, 0.99
#: Part of the mean variance in the variances that whitening divides by.
LEAST_DRAWN = 0.6
#: Cost of one comparison of two codes in a bucket, in entries written and sorted.
COMPARISON = 0.05
#: Entries of one bucket above which the bucket is compared in blocks.
SPLIT_ROWS = 2_048
#: One in so many rows is counted to find crowded buckets.
COUNTED = 16
#: Rows of a side of a block in which a crowded bucket is compared.
BLOCK_ROWS = 2_048


@dataclass(frozen=True)
class Coder:
    """Mean and projection of the learned codes; a few hundred kilobytes."""

    mean: np.ndarray
    projection: np.ndarray

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return ((unit - self.mean) @ self.projection > 0).astype(np.uint8)


def fit_coder(sample: np.ndarray, *, bits: int = BITS, rounds: int = 12, seed: int = 7) -> Coder:
    """PCA whitening followed by iterative quantisation of the unit vectors of a sample, one rotation after another."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    if len(sample) < 2:
        return Coder(np.zeros(dim), rng.normal(size=(dim, bits)))
    mean = sample.mean(0)
    centred = sample - mean
    values, axes = np.linalg.eigh(centred.T @ centred / len(sample))
    keep = values > max(values.max(), 1e-12) * 1e-6
    if not keep.any():
        return Coder(mean, rng.normal(size=(dim, bits)))
    # Variances are drawn to their mean: few vectors make small ones by chance, and full whitening blows up the axes of noise, by which near vectors differ.
    drawn = max(LEAST_DRAWN, dim / (dim + len(sample) / 4))
    white = axes[:, keep] / np.sqrt((1 - drawn) * values[keep] + drawn * values.mean())
    z = (centred @ white)[:ROTATION_ROWS]
    parts = []
    left = bits
    while left > 0:
        width = z.shape[1]
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(z.T @ np.where(z @ r > 0, 1.0, -1.0))
            r = u @ vt
        parts.append(white @ r[:, :left])
        left -= width
    return Coder(mean, np.concatenate(parts, axis=1)[:, :bits])


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # no overflow of the squares
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def usable_vector(vec: Column, dim: int) -> Column:
    """Exactly ``dim`` finite values, not all of them zero."""
    limit = F.lit(float("inf"))
    good = F.forall(vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < limit), F.lit(False)))
    return vec.isNotNull() & (F.size(vec) == dim) & good & F.exists(vec, lambda v: v != 0)


def distinct_vectors(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """``_id``, ``_vec`` of every key with a usable vector; of several the least counts."""
    return df.select(F.col(key).alias("_id"), F.col(vec).alias("_vec")).where(F.col("_id").isNotNull() & usable_vector(F.col("_vec"), dim)).groupBy("_id").agg(F.min("_vec").alias("_vec"))


def hashed_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` rows, at most, by the hash of the key; all rows of a smaller frame."""
    if total <= rows:
        return df
    share = int(0.95 * rows / total * 1_000_000) + 1
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).limit(rows)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim)


def digest(vectors: DataFrame, dim: int) -> DataFrame:
    """``_id``, ``_vec``, ``_c1``, ``_c2`` (hash of the rounded direction), ``_inv`` (one over the length) of each vector.

    Vectors of doubles are made unit vectors, so that no product overflows; floats stay as they are.
    """
    scale = 10.0**COPY_DECIMALS
    weights = np.random.default_rng(11).integers(-(2**62), 2**62, (dim, 2)) | 1  # multilinear hashing modulo 2**64
    as_float = vectors.schema["_vec"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("_vec"), dim)
            unit = unit_rows(raw)
            marks = np.rint(unit * scale).astype(np.int64) @ weights
            if as_float:
                vec, inv = batch.column("_vec"), 1 / np.sqrt((raw.astype(np.float64) ** 2).sum(1))
            else:
                vec, inv = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim, dtype=np.int32)), pa.array(unit.ravel())), np.ones(len(unit))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), vec, pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(inv)], names=["_id", "_vec", "_c1", "_c2", "_inv"])

    kind = vectors.schema["_id"].dataType.simpleString()
    return map_arrow(vectors, run, f"_id {kind}, _vec array<{'float' if as_float else 'double'}>, _c1 bigint, _c2 bigint, _inv double")


@dataclass(frozen=True)
class Index:
    """Substrings of the code: their width and number, and the Hamming radius of its first 64 bits."""

    width: int
    tables: int
    radius: int

    @property
    def bits(self) -> int:
        return max(BITS, self.width * self.tables)

    def entries(self) -> int:
        """Entries that a vector has in the index."""
        return self.tables

    def comparisons(self, rows: int) -> float:
        """Codes that a vector is compared with, for balanced bits of unrelated vectors."""
        return self.tables * rows / 2**self.width

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """Bucket of each code in each table."""
        n, w, m = len(bits), self.width, self.tables
        return (bits[:, : w * m].reshape(n, m, w) @ (1 << np.arange(w)).astype(np.float64)).astype(np.int64) + (np.arange(m) << w)


def plan_index(rows: int, flips: np.ndarray) -> Index:
    """The cheapest width and number of substrings for so many rows.

    ``flips`` has the differing bits of simulated pairs at the threshold, a row per pair. A substring of w
    bits agrees with the chance (1-p)^w of each pair's own share p; there are as many as bring the mean chance of
    an agreement to ``MEET``, without a limit. Narrow substrings need few tables with crowded buckets, wide ones many
    tables with empty buckets; where all of them cost more than all pairs, the width is 0: one bucket.
    """
    p = flips.mean(1)
    best = (1 + COMPARISON * rows / 2, 0, 1)
    for w in range(6, 33):
        miss = np.log1p(-((1 - p) ** w) * 0.999999)
        each = 1 + COMPARISON * rows / 2**w / 2
        m = 1
        while np.exp(miss * m).mean() > 1 - MEET and m * each < best[0]:
            m += 1 if m < 64 else m // 16
        cost = m * each
        if cost < best[0]:
            best = (cost, w, m)
    radius = int(np.quantile(flips[:, :BITS].sum(1), WITHIN, method="higher"))
    return Index(best[1], best[2], radius)


def threshold_flips(sample: np.ndarray, coder: Coder, threshold: float, *, seed: int = 3) -> np.ndarray:
    """Bits that change between sample vectors and random vectors at a cosine of just ``threshold`` to them."""
    rng = np.random.default_rng(seed)
    unit = sample[:TRIAL_ROWS] if len(sample) else unit_rows(rng.normal(size=(100, sample.shape[1])))
    unit = np.tile(unit, (max(1, -(-1_000 // len(unit))), 1))
    noise = rng.normal(size=unit.shape)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    lengths = np.linalg.norm(noise, axis=1, keepdims=True)
    other = threshold * unit + math.sqrt(1 - threshold**2) * noise / np.maximum(lengths, 1e-12)
    return coder.bits(unit) ^ coder.bits(other)


def file_entries(rows: DataFrame, coder: Coder, index: Index, dim: int) -> DataFrame:
    """``_key``, ``_id``, ``_code`` (first 64 bits), ``_t`` (table): the entries of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits = coder.bits(unit_rows(_matrix(batch.column("_vec"), dim)))
            code = np.packbits(bits[:, :BITS], axis=1, bitorder="little").view("<i8").ravel()
            keys = index.keys(bits)
            m = keys.shape[1]
            row, at = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row, at]), batch.column("_id").take(pa.array(row)), pa.array(code[row]), pa.array(at.astype(np.int32))], names=["_key", "_id", "_code", "_t"]
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return map_arrow(rows.select("_id", "_vec"), run, f"_key bigint, _id {kind}, _code bigint, _t int")


def crowded_keys(rows: DataFrame, coder: Coder, index: Index, dim: int, split_rows: int) -> DataFrame:
    """``_key`` of the buckets that hold more than about ``split_rows`` entries, by a hashed share of the rows."""
    one_in = COUNTED if split_rows >= 8 * COUNTED else 1
    part = rows.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(one_in)) == 0) if one_in > 1 else rows
    counts = file_entries(part, coder, index, dim).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > split_rows // one_in).select("_key")


def meeting_pairs(entries: DataFrame, index: Index, *, first_only: bool) -> DataFrame:
    """``_x``, ``_y`` of the entries of one bucket within the Hamming radius; one exchange and sort, then a pass.

    With ``first_only`` a pair counts only in the first of the tables, of those the code shows, in which it meets.
    """
    shown = min(index.tables, BITS // max(index.width, 1))
    ones = np.uint64((1 << index.width) - 1)

    def meet(key: np.ndarray, code: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, at, step = [], [], np.arange(len(key)), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]  # sorted: a row that fails here fails at any greater step
            x = code[at] ^ code[at + step]
            good = np.bitwise_count(x) <= index.radius
            if first_only:
                hits = np.nonzero(good)[0]
                for i in range(shown):
                    again = ((x[hits] >> np.uint64(i * index.width)) & ones == 0) & (t[at[hits]] > i)
                    hits = hits[~again]
                found = at[hits]
            else:
                found = at[good]
            left.append(found)
            right.append(found + step)
            step += 1
        return np.concatenate(left or [at]), np.concatenate(right or [at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b = meet(table.column("_key").to_numpy(), table.column("_code").to_numpy().view(np.uint64), table.column("_t").to_numpy())
            ids = table.column("_id").combine_chunks()
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[i : i + 50_000])), ids.take(pa.array(b[i : i + 50_000]))], names=["_x", "_y"])

        held: pa.Table | None = None  # the last bucket may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held.column("_key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from pairs(held)

    kind = entries.schema["_id"].dataType.simpleString()
    return map_arrow(entries.repartition("_key").sortWithinPartitions("_key"), run, f"_x {kind}, _y {kind}")


def block_pairs(rows: DataFrame, coder: Coder, index: Index, dim: int, k: int, threshold: float, crowded: DataFrame | None = None) -> DataFrame:
    """``_x``, ``_y``: each row's k best of every block among the rows of a bucket (more, where equally good).

    Of the buckets ``crowded`` names; without it, of all. Exact, and quadratic in the rows of a bucket: a row is sent to every
    block of them. Where the buckets overlap so much that all rows in them have fewer pairs, all these rows are one bucket.
    """
    keyed = file_entries(rows, coder, index, dim).select("_key", "_id")
    keyed = materialize(keyed if crowded is None else keyed.join(crowded, "_key", "left_semi"), "dense")
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") ** 2)).first()[0] or 0.0
    if pairs > float(keyed.select("_id").distinct().count()) ** 2:
        keyed = keyed.select(F.lit(0).cast("bigint").alias("_key"), "_id").distinct()
        sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_key", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"))
    keyed = keyed.join(rows.select("_id", "_vec"), "_id").join(sizes, "_key")
    keyed = keyed.withColumn("_own", F.pmod(F.xxhash64("_id", F.lit(5)), F.col("_blocks")).cast("int"))
    sent = keyed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.select("_key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_id", "_vec")
    kind = rows.schema["_id"].dataType.simpleString()

    def best(group: pa.Table) -> pa.Table:
        own, ids = group.column("_own").to_numpy(), group.column("_id").combine_chunks()
        unit = unit_rows(_matrix(group.column("_vec"), dim))
        first, second = np.nonzero(own == own.min())[0], np.nonzero(own == own.max())[0]
        left, right = [], []
        one = own.min() == own.max()
        for a, b in ((first, second), (second, first))[: 1 if one else 2]:
            for i in range(0, len(a), 512):
                part = a[i : i + 512]
                cos = unit[part] @ unit[b].T
                if one:
                    cos[part[:, None] == b[None, :]] = -2.0
                good = cos >= threshold - 1e-9
                many = np.nonzero(np.count_nonzero(good, axis=1) > k)[0]
                if len(many):
                    least = np.partition(cos[many], -k, axis=1)[:, -k] - 1e-12
                    good[many] &= cos[many] >= least[:, None]
                x, y = np.nonzero(good)
                left.append(part[x])
                right.append(b[y])
        return pa.table({"_x": ids.take(pa.array(np.concatenate(left))), "_y": ids.take(pa.array(np.concatenate(right)))})

    ship_package(rows.sparkSession)
    return sent.groupBy("_key", "_i", "_j").applyInArrow(best, f"_x {kind}, _y {kind}")


def candidate_pairs(rows: DataFrame, coder: Coder, index: Index, dim: int, k: int, threshold: float, *, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Distinct ``_a`` < ``_b`` that meet in a bucket and lie within the Hamming radius; of a crowded bucket the k best of each row, at any Hamming distance."""
    rows = rows.select("_id", "_vec")
    crowded = materialize(crowded_keys(rows, coder, index, dim, split_rows), "crowded")
    entries = file_entries(rows, coder, index, dim)
    if crowded.isEmpty():
        out = meeting_pairs(entries, index, first_only=True)
    else:
        out = meeting_pairs(entries.join(crowded, "_key", "left_anti"), index, first_only=False)
        out = out.unionByName(block_pairs(rows, coder, index, dim, k, threshold, crowded))
    return out.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def similar_pairs(df: DataFrame, key: str, vec: str, *, dim: int, k: int = 5, threshold: float = 0.95, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``a`` < ``b``, ``cosine``: pairs of at least ``threshold`` of which one is among the k most similar of the other.

    All vectors are queries and all are indexed; only the rotations and the cost model are fitted
    on a sample (``SAMPLE_ROWS``). Pairs are lost only where their codes agree in no substring or
    differ by more than the Hamming radius, which both are set for pairs at the threshold.

    Defined cases: null keys and vectors that are null, of another length, all zero or with a
    null, NaN or infinite value take no part; repeated rows of a key are one vector, of
    different ones the least; copies have a cosine of 1, and of equally similar vectors
    the lower key comes first, so a class of n copies gives at most n*k pairs; an empty
    table gives an empty result; other columns are ignored.
    """
    coded = materialize(digest(distinct_vectors(df, key, vec, dim), dim), "vectors")
    total = coded.count()
    sample = hashed_sample(coded.select("_id", "_vec"), "_id", SAMPLE_ROWS, total).toArrow()
    unit = unit_rows(_matrix(sample.column("_vec"), dim)) if sample.num_rows else np.zeros((0, dim))
    index = plan_index(max(total, 2), threshold_flips(unit, fit_coder(unit, bits=2 * BITS), threshold))
    coder = fit_coder(unit, bits=index.bits)

    copy = ["_c1", "_c2"]
    several = coded.groupBy(*copy).agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    several = materialize(several, "copies")
    # The k+1 lowest keys of a class are enough; each task keeps only as many per class.
    low = Window.partitionBy("_class").orderBy("_id")
    of_copies = coded.select(*copy, "_id").join(several, copy)
    lowest = of_copies.select("_class", "_id").withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k + 1)
    lowest = materialize(lowest.groupBy("_class").agg(F.sort_array(F.collect_list("_id")).alias("_members")), "members")
    followers = of_copies.where(F.col("_id") != F.col("_class")).select("_id")
    vectors = coded.select("_id", "_vec", "_inv").join(followers, "_id", "left_anti")

    pairs = candidate_pairs(vectors, coder, index, dim, k, threshold, split_rows=split_rows)
    side = lambda s: coded.select(F.col("_id").alias(f"_{s}"), F.col("_vec").alias(f"_v{s}"), F.col("_inv").alias(f"_i{s}"))
    scored = (
        pairs.join(side("a"), "_a")
        .join(side("b"), "_b")
        .select("_a", "_b", (dot(F.col("_va"), F.col("_vb")) * F.col("_ia") * F.col("_ib")).alias("_cos"))
        .where(F.col("_cos") >= threshold)
    )
    both = F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("_b").alias("o")), F.struct(F.col("_b").alias("c"), F.col("_a").alias("o"))))
    ranked = scored.select(both.alias("_e"), "_cos").select(F.col("_e.c").alias("_class"), F.col("_e.o").alias("_other"), "_cos")
    best = Window.partitionBy("_class").orderBy(F.col("_cos").desc(), F.col("_other"))
    ranked = ranked.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    ranked = ranked.join(lowest.withColumnRenamed("_class", "_other"), "_other", "left").withColumn("_members", F.coalesce("_members", F.array("_other")))
    listed = F.transform("_members", lambda m: F.struct(m.alias("id"), F.col("_cos").alias("cos")))
    ranked = ranked.groupBy("_class").agg(F.sort_array(F.collect_list(F.struct("_r", listed.alias("l")))).alias("_lists"))
    others = ranked.select("_class", F.slice(F.flatten(F.transform("_lists", lambda s: s["l"])), 1, k).alias("_others"))
    others = materialize(others, "neighbours")

    own = F.slice(F.filter("_members", lambda m: m != F.col("_id")), 1, k)
    copies = F.transform(own, lambda m: F.struct(m.alias("id"), F.lit(1.0).alias("cos")))
    rest = F.coalesce(F.col("_others"), F.array().cast(others.schema["_others"].dataType))
    among = of_copies.select("_class", "_id").join(lowest, "_class").join(others, "_class", "left").select("_id", F.slice(F.concat(copies, rest), 1, k).alias("_near"))
    single = others.join(several.select("_class"), "_class", "left_anti").select(F.col("_class").alias("_id"), F.col("_others").alias("_near"))
    return (
        among.unionByName(single)
        .select("_id", F.explode("_near").alias("_n"))
        .groupBy(F.least("_id", "_n.id").alias("a"), F.greatest("_id", "_n.id").alias("b"))
        .agg(F.max("_n.cos").alias("cosine"))
    )
