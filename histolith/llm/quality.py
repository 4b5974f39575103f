"""Per-document text statistics, and an ordered rule list learned on labelled documents.

The statistics cover whole texts and are worked out on arrays of code points (``textstats``), without a
shuffle. The rules are induced by incremental reduced-error pruning: for each kind, rarest
first, a rule is grown on two thirds of the labelled documents by information gain, cut
back on the other third, kept while it is right more often than wrong there, and its
documents are taken out. What comes out is thresholds, which are exported as one CASE
expression and applied natively to all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histolith.llm import textstats
from histolith.session import map_arrow, spread

#: Labelled documents the rules are fitted on, at most; more are thinned by the hash of the id.
FIT_ROWS = 50_000
#: Common words are compared as a hash set within the expression, so their number is bounded.
MOST_COMMON_WORDS = 5_000
OTHER = "prose"
#: Statistics that are reported but give no rules, since the kind does not follow from the size.
SIZES = ("n_chars", "n_lines")


def document_statistics(docs: DataFrame, key: str, text: str, common_words: list[str], *, only: set[str] | None = None) -> DataFrame:
    """``key`` and one double column per statistic (``only`` those named), a row per row of the input.

    CJK characters count as a term each; white space is that of ASCII and of Unicode.

    Defined cases: null, empty and blank texts have 0 in every statistic; texts of any length
    are counted whole; ratios with an empty denominator are 0; other columns are ignored, so
    clashing names do no harm.
    """
    if len(common_words) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    names = [n for n in textstats.STATISTICS if only is None or n in only]
    common = textstats.word_hashes(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_t").to_pylist()]
            for a, b in textstats.chunks(texts):
                found = textstats.statistics(texts[a:b], common)
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(a, b - a), *[pa.array(found[n]) for n in names]], names=["_key", *names])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
    return map_arrow(src, run, ", ".join([f"_key {kind}", *[f"{n} double" for n in names]])).withColumnRenamed("_key", key)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bound: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        return x >= self.bound if self.at_least else x < self.bound

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.bound if self.at_least else c < self.bound


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    kind: str


def _covered(conditions: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in conditions:
        m &= c.mask(x[:, names.index(c.feature)])
    return m


def _best_condition(x: np.ndarray, pos: np.ndarray, names: list[str]) -> tuple[float, Condition] | None:
    """The threshold of greatest FOIL gain on the rows still covered."""
    p0, n0 = pos.sum(), (~pos).sum()
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition] | None = None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, y = x[order, j], pos[order]
        cut = np.nonzero(v[1:] > v[:-1])[0]  # between row i and i+1
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for at_least, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), 0.0)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (float(gain[i]), Condition(name, at_least, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def induce_rules(x: np.ndarray, labels: np.ndarray, names: list[str], *, other: str = OTHER, splits: int = 12, longest: int = 6) -> list[Rule]:
    """The best of several rule lists: fewest wrong labels, where each condition weighs as one.

    The lists differ in the split of rows into those that grow and those that prune rules.
    """

    def cost(rules: list[Rule]) -> float:
        wrong = (apply_rules(x, rules, names, other) != labels).sum()
        return float(wrong) + sum(len(r.conditions) for r in rules)

    return min((_induce_once(x, labels, names, other, seed, longest) for seed in range(splits)), key=cost, default=[])


def _induce_once(x: np.ndarray, labels: np.ndarray, names: list[str], other: str, seed: int, longest: int) -> list[Rule]:
    """An ordered rule list for all kinds but ``other``, rarest kind first.

    Deterministic for given rows. Kinds without any labelled document get no rule; with too few
    for a held-out third, rules are judged on the rows they were grown on.
    """
    rng = np.random.default_rng(seed)
    kinds, sizes = np.unique(labels, return_counts=True)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for kind in [k for _, k in sorted(zip(sizes.tolist(), kinds.tolist())) if k != other]:
        misses = 0
        while (left & (labels == kind)).sum() >= 2 and misses < 3:
            rows = np.nonzero(left)[0]
            positive = labels[rows] == kind
            held = np.zeros(len(rows), bool)
            for group in (positive, ~positive):
                own = rng.permutation(np.nonzero(group)[0])
                held[own[: len(own) // 3]] = True
            if positive[held].sum() < 2:
                held[:] = True
                grow = held
            else:
                grow = ~held
            gx, gy = x[rows[grow]], positive[grow]
            conditions: list[Condition] = []
            m = np.ones(len(gx), bool)
            while (~gy[m]).any() and len(conditions) < longest:
                found = _best_condition(gx[m], gy[m], names)
                if found is None:
                    break
                conditions.append(found[1])
                m &= found[1].mask(gx[:, names.index(found[1].feature)])
            hx, hy = x[rows[held]], positive[held]

            def worth(cs: list[Condition]) -> tuple[float, int]:
                c = _covered(cs, hx, names)
                p, n = int(hy[c].sum()), int((~hy[c]).sum())
                return ((p - n) / (p + n) if p + n else -1.0, p)

            kept = max((conditions[:i] for i in range(1, len(conditions) + 1)), key=worth, default=[])
            value, _ = worth(kept) if kept else (-1.0, 0)
            covered = _covered(kept, x, names) & left if kept else np.zeros(len(x), bool)
            if value <= 0 or not (labels[covered] == kind).any():
                misses += 1
                continue
            rules.append(Rule(tuple(kept), kind))
            left &= ~covered
    return rules


def apply_rules(x: np.ndarray, rules: list[Rule], names: list[str], other: str = OTHER) -> np.ndarray:
    out = np.full(len(x), other, dtype=object)
    free = np.ones(len(x), bool)
    for r in rules:
        m = _covered(list(r.conditions), x, names) & free
        out[m] = r.kind
        free &= ~m
    return out


def rule_case(rules: list[Rule], other: str = OTHER) -> Column:
    """The rule list as one CASE expression over the columns of the statistics."""
    out: Column | None = None
    for r in rules:
        test = F.lit(True)
        for c in r.conditions:
            test = test & c.column()
        out = F.when(test, F.lit(r.kind)) if out is None else out.when(test, F.lit(r.kind))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def majority_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, ``label``: what most raters say; of equal numbers the alphabetically first."""
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias(key), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(key).agg(F.max_by("label", F.struct(F.col("_n"), F.lit(0))).alias("_any"), F.min(F.struct((-F.col("_n")).alias("n"), "label")).alias("_m")).select(key, F.col("_m.label").alias("label"))


def fit_rules(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, common_words: list[str], *, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules learned on at most ``fit_rows`` labelled documents, chosen by the hash of their id."""
    voted = majority_labels(labels, key, label)
    total = voted.count()
    if total > fit_rows:
        voted = voted.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(fit_rows / total * 1_000_000))
    usable = docs.where(F.col(text).rlike(r"\S")).select(key, text).join(voted.hint("shuffle_hash") if total > 1_000_000 else voted, key)
    usable = usable.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # at most `fit_rows` labelled texts
    stats = document_statistics(usable, key, text, common_words).join(voted, key).orderBy(key).toPandas()
    names = [c for c in stats.columns if c not in (key, "label", *SIZES)]
    return induce_rules(stats[names].to_numpy(float), stats["label"].to_numpy(object).astype(str), names)


def classify(
    docs: DataFrame, key: str, text: str, rules: list[Rule], common_words: list[str], *, ignored: tuple[str, ...] = ("[deleted]",), without: str | None = None
) -> DataFrame:
    """``key``, ``kind`` of every document with a text; null, blank and ``ignored`` texts have no row, nor has the kind ``without``."""
    usable = docs.where(F.col(text).rlike(r"\S") & ~F.trim(F.col(text)).isin(*ignored))
    used = {c.feature for r in rules for c in r.conditions}
    kinds = document_statistics(spread(usable.select(key, text)), key, text, common_words, only=used).select(key, rule_case(rules).alias("kind"))
    return kinds.where(F.col("kind") != without) if without is not None else kinds
