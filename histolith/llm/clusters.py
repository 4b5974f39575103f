"""Groups of mutually similar records, by a Gaussian mixture over reduced features.

Unit vectors are standardised and reduced to the principal axes that stand out from the noise
floor. Mixtures of several sizes are fitted by expectation-maximisation side by side: each
pass over all rows collects the sufficient statistics of every candidate in one mapInArrow job, partial
sums are added up in a tree, and only a few matrices reach the driver. Covariances are
regularised towards a sphere, every mixture has one broad background component
for records like no group, and the Bayesian information criterion over all rows picks the size.
The starting points of the mixture come from all rows: a small table is compared at once, in others slice by slice every record that no group found so far explains is tried as
that is no member of a group found so far is tried as the seed of one more, its neighbours counted over all such records, so neither the number of groups nor their share of the table is limited.
That search is quadratic in the records like no group. What the mixture leaves unexplained is searched once more; the groups that
finds get axes and components of their own, and expectation-maximisation goes on with them over all rows. No sample is drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import lgamma, log
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histolith.llm.vectors import _matrix, distinct_vectors, unit_rows
from histolith.session import map_arrow, materialize

#: Partial sums that one task adds up.
FAN_IN = 64
#: Records of one group are at least this similar on average, records of different groups less.
SIMILAR = 0.4
#: Pseudo-rows by which a covariance is drawn to the sphere of the noise.
PRIOR_ROWS = 20.0
#: Candidate sizes that are fitted side by side over all rows, in two shapes each.
CANDIDATES = 8
JOINT_PASSES, FINAL_PASSES = 3, 12
#: Mahalanobis distance, in standard deviations of its chi distribution, up to which a record counts for the mean of its group.
REACH = 4.5
#: A record belongs to a group if its mean cosine with the members is at least this part of `similar`.
LIKE_MEMBERS = 0.8
#: Part of the squared length of a group's mean that the axes may miss before it gets an axis of its own.
MISSED = 0.1
#: Unexplained records tried as seeds in one pass over all unexplained records, on average; fewer at first, when none is explained.
SLICE_ROWS, FIRST_ROWS = 3_500, 500
#: Tables of no more rows are compared at once, on the driver.
WHOLE_ROWS = 4_096
#: Range of the hashes by which records are dealt to slices.
PLACES = 1 << 40
#: Expected number of groups that chance makes of unrelated records.
BY_CHANCE = 0.01
#: Rows whose cosines with all seeds are held at a time.
BLOCK_ROWS = 1_024


def tree_sum(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """Sum of one array per partition; partial sums are added on the executors first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fn(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(out, np.float64).tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                a = np.frombuffer(value.as_py(), np.float64)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = map_arrow(df, partial, "part binary")
    n = df.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = map_arrow(parts.repartition(n), add, "part binary")
    rows = parts.collect()
    return np.sum([np.frombuffer(r[0], np.float64) for r in rows], axis=0) if rows else None


@dataclass(frozen=True)
class Reduction:
    """Standardisation and projection of unit vectors, and the noise level of the result."""

    mean: np.ndarray
    std: np.ndarray
    axes: np.ndarray
    noise: float

    def apply(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ (self.axes / self.std[:, None])

    def missed(self, directions: np.ndarray) -> np.ndarray:
        """Those of the directions that the axes do not show well enough."""
        v = (directions - self.mean) / self.std
        left = v - v @ self.axes @ self.axes.T
        return directions[(left**2).sum(1) > MISSED * (v**2).sum(1)]

    def widened(self, directions: np.ndarray) -> Reduction:
        """With further axes, in which the means of ``directions`` differ from the overall mean."""
        axes = self.axes
        for v in (directions - self.mean) / self.std:
            for _ in range(2):
                v = v - axes @ (axes.T @ v)
            if axes.shape[1] < len(v) and np.linalg.norm(v) > 1e-3 * np.sqrt(len(v)):
                axes = np.column_stack([axes, v / np.linalg.norm(v)])
        return Reduction(self.mean, self.std, axes, self.noise)


def fit_reduction(vectors: DataFrame, dim: int) -> tuple[Reduction, int]:
    """Standardise and keep the axes whose variance stands out from the median axis; over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                u = unit_rows(_matrix(batch.column("_vec"), dim))
                part = np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])
                total = part if total is None else total + part
        return total

    sums = tree_sum(vectors.select("_vec"), moments)
    if sums is None:
        return Reduction(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), 1.0), 0
    n = int(sums[0])
    mean = sums[1 : dim + 1] / n
    cov = sums[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, axes = np.linalg.eigh(cov / np.outer(std, std))
    floor = float(np.median(values))
    keep = np.argsort(values)[::-1][: max(2, int((values > 1.15 * floor).sum()))]
    return Reduction(mean, std, axes[:, keep], max(floor, 1e-9)), n


@dataclass
class Mixture:
    """Weights, means and covariances; the last component is the broad background. All covariances of a spherical one are spheres."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    spherical: bool
    loglik: float = -np.inf

    def log_density(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log(weight * density) and squared Mahalanobis distance by row and component."""
        n, d = z.shape
        k = len(self.weights)
        if self.spherical:
            level = self.covs[:, 0, 0]
            maha = np.maximum((z * z).sum(1)[:, None] - 2 * z @ self.means.T + (self.means**2).sum(1), 0) / level
            return np.log(np.maximum(self.weights, 1e-300)) - 0.5 * (maha + d * np.log(2 * np.pi * level)), maha
        out, maha = np.empty((n, k)), np.empty((n, k))
        for j in range(k):
            chol = np.linalg.cholesky(self.covs[j])
            y = (z - self.means[j]) @ np.linalg.inv(chol).T
            maha[:, j] = np.einsum("ij,ij->i", y, y)
            out[:, j] = np.log(max(self.weights[j], 1e-300)) - 0.5 * (maha[:, j] + d * np.log(2 * np.pi)) - np.log(np.diag(chol)).sum()
        return out, maha

    def statistics(self, z: np.ndarray) -> np.ndarray:
        """Log-likelihood, then counts, sums and second moments (of a spherical one their mean on the diagonal) of the components, flat."""
        log, _ = self.log_density(z)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(1, keepdims=True)
        r = p / total
        if self.spherical:
            second = ((z * z).sum(1) @ r)[:, None, None] * np.eye(z.shape[1]) / z.shape[1]
        else:
            second = [(z * r[:, j : j + 1]).T @ z for j in range(len(self.weights))]
        return np.concatenate([[float((top + np.log(total)).sum())], r.sum(0), (r.T @ z).ravel(), np.array(second).ravel()])

    def length(self) -> int:
        k, d = self.means.shape
        return 1 + k + k * d + k * d * d

    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + (k if self.spherical else k * d * (d + 1) // 2)

    def step(self, stats: np.ndarray, noise: float) -> Mixture:
        """The mixture after one maximisation step; ``loglik`` is that of the parameters before."""
        k, d = self.means.shape
        counts = np.maximum(stats[1 : k + 1], 1e-9)
        means = stats[k + 1 : k + 1 + k * d].reshape(k, d) / counts[:, None]
        second = stats[k + 1 + k * d :].reshape(k, d, d) / counts[:, None, None]
        covs = second - np.einsum("ki,kj->kij", means, means)
        eye = np.eye(d)
        if self.spherical:
            level = np.maximum(np.trace(covs, axis1=1, axis2=2) / d, 1e-9)
            covs = level[:, None, None] * eye
        covs = (counts[:, None, None] * covs + PRIOR_ROWS * noise * eye) / (counts + PRIOR_ROWS)[:, None, None]
        covs[-1] = self.covs[-1]  # the background stays broad, or it would become one more group
        means[-1] = self.means[-1]
        return Mixture(counts / counts.sum(), means, covs, self.spherical, float(stats[0]))

    def bic(self, n: int) -> float:
        return -2 * self.loglik + self.parameters() * np.log(max(n, 2))


def seed_members(unit: np.ndarray, similar: float) -> list[np.ndarray]:
    """Rows of dense neighbourhoods of a small table, densest first, no row in two of them."""
    near = (unit @ unit.T).astype(np.float32) >= similar
    free = np.ones(len(unit), bool)
    least = max(4, len(unit) // 1000)
    out = []
    counts = near.sum(1, dtype=np.int64)
    while len(counts):
        best = int((counts * free).argmax())
        if not free[best] or counts[best] < least:
            break
        members = np.nonzero(near[best] & free)[0]
        # The mean of the neighbourhood draws in the members that the seed itself is too far from.
        centre = unit[members].mean(0)
        centre /= np.linalg.norm(centre)
        members = np.nonzero(free & (unit @ centre >= np.sqrt(similar) * 0.9))[0]
        if not len(members):
            members = np.array([best])
        gone = np.union1d(members, [best])
        free[gone] = False
        counts -= near[:, gone].sum(1, dtype=np.int64)
        if len(members) >= least:
            out.append(members)
    return out


def _pass(features: DataFrame, mixtures: list[Mixture], d: int, noise: float) -> list[Mixture]:
    """One expectation step over all rows for every candidate, and the maximisation."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column("_z"), d)
                part = np.concatenate([m.statistics(z) for m in mixtures])
                total = part if total is None else total + part
        return total

    stats = tree_sum(features.select("_z"), run)
    edges = np.cumsum([0, *[m.length() for m in mixtures]])
    return [m.step(stats[a:b], noise) for m, a, b in zip(mixtures, edges, edges[1:])]


def fit_mixture(features: DataFrame, candidates: list[Mixture], d: int, noise: float, n: int) -> Mixture:
    """Expectation-maximisation of all candidates, choice by BIC, and convergence of the chosen one."""
    for _ in range(JOINT_PASSES):
        candidates = _pass(features, candidates, d, noise)
    best = min(candidates, key=lambda m: m.bic(n))
    for _ in range(FINAL_PASSES):
        before = best.loglik
        best = _pass(features, [best], d, noise)[0]
        if abs(best.loglik - before) < 1e-5 * abs(before):
            break
    return best


def least_members(n: int, dim: int, similar: float) -> int:
    """Size from which ``n`` unrelated vectors are not expected to hold a group; grows with log(n)."""
    m = 4
    while m < n:
        z = 0.9 * similar * np.sqrt(m * (m - 1) / 2 * dim)  # their mean cosine in standard deviations
        if lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) - z * z / 2 < log(BY_CHANCE):
            break
        m += 1
    return m


def _neighbourhoods(rest: DataFrame, seeds: np.ndarray, near: float, known: np.ndarray, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the rows of a cosine of at least ``near`` with each seed, without those like a known group."""
    k, dim = seeds.shape

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(_matrix(batch.column("_vec"), dim))
            if len(known):
                unit = unit[(unit @ known.T).max(1) < like]
            total = np.zeros((k, dim + 1)) if total is None else total
            for i in range(0, len(unit), BLOCK_ROWS):
                part = unit[i : i + BLOCK_ROWS]
                hit = (seeds @ part.T >= near).astype(np.float64)
                total += np.column_stack([hit @ part, hit.sum(1)])
        return None if total is None else total.ravel()

    stats = tree_sum(rest.select("_vec"), run)
    stats = np.zeros((k, dim + 1)) if stats is None else stats.reshape(k, dim + 1)
    return stats[:, -1], stats[:, :-1]


def _directions(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def further_groups(rest: DataFrame, n: int, dim: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the members of the groups among ``n`` rows that no group explains.

    Every row is a seed once, unless a group found before explains it. Its neighbourhood, closer than chance, gives a centre, and the rows
    around the centre the members; a group has at least ``least_members`` with a mean cosine as in ``name_groups``.
    """
    like, around = LIKE_MEMBERS * similar, np.sqrt(similar) * 0.9
    least = least_members(n, dim, similar)
    close = max(similar, NormalDist().inv_cdf(1 - 1 / max(n, 2)) / np.sqrt(dim))
    sums, counts = np.zeros((0, dim)), np.zeros(0)
    place = F.pmod(F.xxhash64("_id"), F.lit(PLACES))
    start, left, size = 0, n, FIRST_ROWS if n > SLICE_ROWS else n
    while start < PLACES and left >= least:
        end = min(PLACES, start + PLACES * size // max(left, 1) + 1)
        seeds = unit_rows(_matrix(rest.where((place >= start) & (place < end)).select("_vec").toArrow().column("_vec"), dim))
        start, size, found = end, SLICE_ROWS, len(counts)
        known = sums / counts[:, None]
        while True:
            if len(known) and len(seeds):
                seeds = seeds[(seeds @ known.T).max(1) < like]
            if not len(seeds):
                break
            number, total = _neighbourhoods(rest, seeds, close, known, like)
            seeds, total = seeds[number >= 3], total[number >= 3]
            if not len(seeds):
                break
            for _ in range(2):
                number, total = _neighbourhoods(rest, _directions(total), around, known, like)
            inner = ((total**2).sum(1) - number) / np.maximum(number * (number - 1), 1)
            good = np.nonzero((number >= least) & (inner >= similar * 0.9))[0]
            before = len(counts)
            for g in good[np.argsort(-number[good], kind="stable")]:
                new = total[g] / number[g]
                if all(new @ m / np.linalg.norm(m) < around * np.linalg.norm(new) for m in known[before:]):
                    sums, counts = np.vstack([sums, total[g]]), np.append(counts, number[g])
                    known = sums / counts[:, None]
            if len(counts) == before:
                break
        if len(counts) > found and start < PLACES:
            rest = _unlike(rest, known, like)
            left = rest.count()
    return sums, counts


def starting_groups(vectors: DataFrame, n: int, dim: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the members of the groups from which the mixture starts, always of all rows; at once where they are few."""
    if n > WHOLE_ROWS:
        return further_groups(vectors, n, dim, similar)
    unit = unit_rows(_matrix(vectors.select("_vec").toArrow().column("_vec"), dim)) if n else np.zeros((0, dim))
    members = seed_members(unit, similar)
    return np.array([unit[m].sum(0) for m in members]).reshape(-1, dim), np.array([float(len(m)) for m in members])


def _unlike(rows: DataFrame, known: np.ndarray, like: float) -> DataFrame:
    """``_id``, ``_vec`` of the rows that are like no known group."""
    dim = known.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array((unit_rows(_matrix(batch.column("_vec"), dim)) @ known.T).max(1) < like))

    return materialize(map_arrow(rows.select("_id", "_vec"), run, f"_id {_kind(rows, '_id')}, _vec {_kind(rows, '_vec')}"), "unlike")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def similarity_groups(df: DataFrame, key: str, vec: str, *, dim: int, similar: float = SIMILAR) -> DataFrame:
    """``key``, ``group``, ``density`` of the records that belong to a group; groups count from 0, largest first.

    A record belongs to the group of its component of greatest responsibility; an exact check follows, that it is like the
    members on average. The others are searched for further groups, with which the mixture is fitted again.
    Components whose records are not similar to each other on average (``similar``) are no group; components whose records
    are similar to those of another are one group with it. Density is the log-density of the component.

    Defined cases: null keys and vectors that are null, of another length, all zero or with a null, NaN or
    infinite value take no part; repeated rows of a key are one record, of different vectors the least;
    exact copies share their group; tables with too few records for any group give no rows; other columns
    are ignored.
    """
    vectors = materialize(distinct_vectors(df, key, vec, dim), "vectors")
    kind = _kind(vectors, "_id")
    reduction, n = fit_reduction(vectors, dim)
    like = LIKE_MEMBERS * similar
    sums, numbers = starting_groups(vectors, n, dim, similar)
    candidates = []
    if len(numbers):
        means = (sums / numbers[:, None])[np.argsort(-numbers, kind="stable")]
        reduction = reduction.widened(reduction.missed(means))
        sizes = sorted({max(1, round(len(means) * s)) for s in np.linspace(0.3, 1.0, CANDIDATES)})
        candidates = _started(vectors, reduction, means, like, n, sizes)
    model = _fitted(vectors, reduction, candidates, dim, n, similar)

    def unexplained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                likeness = model.assign(unit_rows(_matrix(batch.column("_vec"), dim)))[2]
                yield batch.filter(pa.array(likeness < like))

    rest = materialize(map_arrow(vectors.select("_id", "_vec"), unexplained, f"_id {kind}, _vec {_kind(vectors, '_vec')}"), "rest")
    more, numbers = further_groups(rest, rest.count(), dim, similar)
    final = model
    if len(numbers):
        means = np.vstack([model.means[: model.groups], more / numbers[:, None]])
        wider = reduction.widened(more / numbers[:, None])
        final = _fitted(vectors, wider, _started(vectors, wider, means, like, n, [len(means)]), dim, n, similar, known=means)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                group, density, likeness = final.assign(unit_rows(_matrix(batch.column("_vec"), dim)))
                out = pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(group.astype(np.int32)), pa.array(density)], names=["_id", "_group", "_density"])
                yield out.filter(pa.array(likeness >= like))

    schema = f"_id {kind}, _group int, _density double"
    return map_arrow(vectors, assign, schema).select(F.col("_id").alias(key), F.col("_group").alias("group"), F.col("_density").alias("density"))


@dataclass(frozen=True)
class Grouping:
    """A fitted mixture, the group of each component (-1 for none) and the mean vector of each group."""

    reduction: Reduction
    mixture: Mixture | None
    names: np.ndarray
    means: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.names.max(initial=-1)) + 1

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of greatest responsibility, its log-density and the mean cosine with its members; -1 without any group."""
        grouped = np.nonzero(self.names >= 0)[0]
        if not len(grouped):
            return np.full(len(unit), -1), np.zeros(len(unit)), np.full(len(unit), -1.0)
        log, _ = self.mixture.log_density(self.reduction.apply(unit))
        group = self.names[grouped[log[:, grouped].argmax(1)]]
        return group, log[:, grouped].max(1), (unit * self.means[group]).sum(1)


def _fitted(vectors: DataFrame, reduction: Reduction, candidates: list[Mixture], dim: int, n: int, similar: float, known: np.ndarray | None = None) -> Grouping:
    """The best candidate, fitted over all rows, and the groups its components make.

    With ``known`` means of the components, a record that is not like that of its component does not count for the new mean.
    """
    if not candidates:
        return Grouping(reduction, None, np.array([-1]), np.zeros((1, dim)))
    d = reduction.axes.shape[1]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = reduction.apply(unit_rows(_matrix(batch.column("_vec"), dim))) if batch.num_rows else np.zeros((0, d))
            offsets = pa.array(np.arange(0, z.size + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["_z"])

    features = materialize(map_arrow(vectors.select("_vec"), reduce, "_z array<double>"), "features")
    mixture = fit_mixture(features, candidates, d, reduction.noise, n)
    background = len(mixture.weights) - 1
    reach = (np.sqrt(d - 0.5) + REACH / np.sqrt(2)) ** 2

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        """Sum and number of the records of each component, without the background's and those out of reach."""
        total = np.zeros((background, dim + 1))
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(_matrix(batch.column("_vec"), dim))
                log, maha = mixture.log_density(reduction.apply(unit))
                c = log.argmax(1)
                c[(maha[np.arange(len(c)), c] > reach) | (c == background)] = -1
                if known is not None:
                    c[(unit * known[np.maximum(c, 0)]).sum(1) < LIKE_MEMBERS * similar] = -1
                for j in np.unique(c[c >= 0]):
                    total[j] += np.append(unit[c == j].sum(0), (c == j).sum())
        return total.ravel()

    totals = tree_sum(vectors.select("_vec"), sums).reshape(background, dim + 1)
    names, means = named_means(totals, similar)
    return Grouping(reduction, mixture, names, means)


def _started(vectors: DataFrame, reduction: Reduction, means: np.ndarray, like: float, n: int, sizes: list[int]) -> list[Mixture]:
    """Mixtures of both shapes with a component for each of the first known groups, started from the rows nearest to its mean."""
    k, d = len(means), reduction.axes.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k + 1, d + 2))
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(_matrix(batch.column("_vec"), means.shape[1]))
                z = reduction.apply(unit)
                likeness = unit @ means.T
                c = np.where(likeness.max(1) >= like, likeness.argmax(1), k)
                part = np.column_stack([np.ones(len(z)), z, (z * z).sum(1)])
                np.add.at(total, c, part)
        return total.ravel()

    total = tree_sum(vectors.select("_vec"), moments).reshape(k + 1, d + 2)
    counts = np.maximum(total[:, 0], 1.0)
    centres = total[:, 1:-1] / counts[:, None]
    level = np.maximum(total[:, -1] / counts - (centres**2).sum(1), 0) / d
    level = np.maximum(level, 0.25 * reduction.noise)
    level[:k] = (counts[:k] * level[:k] + PRIOR_ROWS * reduction.noise) / (counts[:k] + PRIOR_ROWS)
    whole = total[:, :].sum(0)
    centre = whole[1:-1] / max(whole[0], 1)
    centres[k], level[k] = centre, 1.5 * max(whole[-1] / max(whole[0], 1) - (centre**2).sum(), reduction.noise) / d
    out = []
    for size in sizes:
        taken = [*range(size), k]
        weights = np.append(counts[:size] / max(n, 1), max(0.02, 1 - total[:size, 0].sum() / max(n, 1)))
        covs = level[taken][:, None, None] * np.eye(d)
        out += [Mixture(weights / weights.sum(), centres[taken], covs, shape) for shape in (True, False)]
    return out


def named_means(totals: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """``name_groups`` of components given as sums and count, and the mean vector of every group."""
    names = name_groups(totals[:, :-1], totals[:, -1], similar)
    means = np.zeros((max(int(names.max()) + 1, 1), totals.shape[1] - 1))
    for g in range(int(names.max()) + 1):
        means[g] = totals[names == g, :-1].sum(0) / max(totals[names == g, -1].sum(), 1)
    return names, means


def name_groups(sums: np.ndarray, counts: np.ndarray, similar: float) -> np.ndarray:
    """Group number of every component, -1 for none; joins components that are similar to each other."""
    k = len(counts)
    inner = ((sums**2).sum(1) - counts) / np.maximum(counts * (counts - 1), 1)
    good = (counts >= 2) & (inner >= similar * 0.9)
    cross = (sums @ sums.T) / np.maximum(np.outer(counts, counts), 1)
    root = np.arange(k)
    for i in range(k):
        for j in range(i):
            if good[i] and good[j] and cross[i, j] >= similar:
                root[root == root[i]] = root[j]
    size = {r: counts[(root == r) & good].sum() for r in set(root[good].tolist())}
    rank = {r: i for i, r in enumerate(sorted(size, key=lambda r: (-size[r], r)))}
    return np.array([rank[root[i]] if good[i] else -1 for i in range(k)] or [-1], dtype=np.int64)


def describe_groups(groups: DataFrame, key: str, *, typical: int = 5) -> DataFrame:
    """``group``, ``size``, ``typical``: number of records and the keys of highest density."""
    order = Window.partitionBy("group").orderBy(F.col("density").desc(), F.col(key))
    top = groups.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= typical)
    top = top.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("_r", key))).alias("_t")).select("group", F.col(f"_t.{key}").alias("typical"))
    return groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")).join(top, "group")


def label_conflicts(groups: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, ``group_label``: records whose label is not the one most records of their group carry, or is null.

    ``labels`` has one row per key. Of equally frequent labels the least counts; groups
    without any label give no rows.
    """
    labelled = groups.select(key, "group").join(labels.select(key, F.col(label).alias("_label")), key)
    votes = labelled.where(F.col("_label").isNotNull()).groupBy("group", "_label").agg(F.count(F.lit(1)).alias("_n"))
    chosen = votes.groupBy("group").agg(F.min(F.struct((-F.col("_n")).alias("n"), "_label")).alias("_m")).select("group", F.col("_m._label").alias("group_label"))
    return labelled.join(chosen, "group").where(~F.col("_label").eqNullSafe(F.col("group_label"))).select(key, "group_label")
