"""Queries of the corpus problems, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolith.llm import bpe, clusters, packing, quality, sketches, terms, vectors
from histolith.operators.latest import clean_name, latest_rows
from histolith.session import materialize, table

RARE_BELOW = 5
COMMON_FEATURE, COMMON_CLUSTER = 0.60, 0.20
LOW_QV, HIGH_Z, LEAST_VALUES = 20.0, 30.0, 20


def feature_tokens(spark: SparkSession, d: str) -> DataFrame:
    """term and cell of every transcript that counts; cell is null where there is none."""
    t = table(spark, d, "transcripts").select("transcript_id", "ingested_at", clean_name(F.col("feature_name")).alias("term"), F.when(F.col("cell_id") != -1, F.col("cell_id")).alias("cell"))
    return latest_rows(t, "transcript_id", "ingested_at", ["term", "cell"]).select("term", "cell")


def cluster_tokens(spark: SparkSession, d: str) -> DataFrame:
    label = F.regexp_replace("cluster", "[^A-Za-z0-9]", "")
    return table(spark, d, "annotation").select(F.when(label != "", label).alias("term"), "barcode").where(F.col("term").isNotNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(feature_tokens(spark, d), "feature-tokens")
    features = terms.mark_terms(
        terms.term_frequencies(tokens, "term", "cell"), terms.distinct_records(tokens, "cell"), rare_below=RARE_BELOW, common_above=COMMON_FEATURE
    )
    labels = cluster_tokens(spark, d)
    clusters = terms.mark_terms(
        terms.term_frequencies(labels, "term", "barcode"), terms.distinct_records(labels, "barcode"), rare_below=RARE_BELOW, common_above=COMMON_CLUSTER, rare_by="records"
    )
    return features.select(F.lit("feature_name").alias("field"), "term", "mark").unionByName(clusters.select(F.lit("cluster").alias("field"), "term", "mark"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every name and label."""
    features = terms.term_frequencies(feature_tokens(spark, d), "term", "cell")
    clusters = terms.term_frequencies(cluster_tokens(spark, d), "term", "barcode")
    return features.select(F.lit("feature_name").alias("field"), "*").unionByName(clusters.select(F.lit("cluster").alias("field"), "*"))


def measured(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("transcript_id", "ingested_at", clean_name(F.col("feature_name")).alias("feature_name"), "run_day", "qv", "z")
    t = latest_rows(t, "transcript_id", "ingested_at", ["feature_name", "run_day", "qv", "z"])
    return t.where(F.col("feature_name").isNotNull()).select("feature_name", "run_day", "qv", "z")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(measured(spark, d), "measured")
    tests = [("qv", 0.5, "<", LOW_QV), ("z", 0.9, ">", HIGH_Z)]
    return sketches.percentile_tests(rows, ["feature_name", "run_day"], tests, least=LEAST_VALUES)


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per name over all days, merged from the sketches of the single days."""
    days = sketches.sketch(measured(spark, d), ["feature_name", "run_day"], ["qv", "z"])
    return sketches.quantiles(sketches.merge(days, ["feature_name"], ["qv", "z"]), ["feature_name"], ["qv", "z"], [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])


VECTOR_DIM, MIN_COSINE, NEIGHBOURS = 64, 0.95, 5


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = vectors.similar_pairs(table(spark, d, "cell_table"), "cell_id", "x_vec", dim=VECTOR_DIM, k=NEIGHBOURS, threshold=MIN_COSINE)
    return pairs.select(F.col("a").alias("cell_id_a"), F.col("b").alias("cell_id_b"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"), "doc_id", "text")


CONTAINER_TOKENS = 2048


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cell_table").where(F.col("cell_id").isNotNull()).groupBy("cell_id").agg(F.max("leiden").alias("leiden"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    groups = materialize(clusters.similarity_groups(table(spark, d, "cell_table"), "cell_id", "x_vec", dim=VECTOR_DIM), "groups")
    return clusters.label_conflicts(groups, cell_labels(spark, d), "cell_id", "leiden").withColumnRenamed("group_label", "cluster_label")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical cells of each group."""
    groups = materialize(clusters.similarity_groups(table(spark, d, "cell_table"), "cell_id", "x_vec", dim=VECTOR_DIM), "groups")
    return clusters.describe_groups(groups, "cell_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every post, or of each part of a divided post."""
    sizes = bpe.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER_TOKENS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The posts that finished containers hold in more than one place."""
    parts = p8_containers(spark, d).groupBy("doc_id").agg(F.min("container").alias("low"), F.max("container").alias("high"))
    return parts.where(F.col("low") < F.col("high")).select("doc_id")


def p8_loads(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: no load above the capacity, every token in its place once, nearly no container more than the tokens need."""
    sizes = materialize(bpe.count_tokens(table(spark, d, "documents"), "doc_id", "text"), "token-counts")
    placed = materialize(packing.pack(sizes, "doc_id", "n_tokens", CONTAINER_TOKENS), "containers")
    loads = placed.groupBy("container").agg(F.sum("size").alias("load")).agg(
        F.count_if(F.col("load") > CONTAINER_TOKENS).alias("overfull"), (F.max("container") + 1).alias("containers"), F.count(F.lit(1)).alias("used")
    )
    runs = placed.groupBy("doc_id").agg(F.sum("size").alias("placed"), F.max(F.col("start") + F.col("size")).alias("reach"), F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("pieces"))
    wrong = sizes.join(runs, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens")) | (F.col("reach") != F.col("n_tokens")) | (F.col("parts") != F.col("pieces"))).alias("misplaced"),
        F.ceil(F.sum("n_tokens") / CONTAINER_TOKENS).alias("least"),
    )
    both = loads.join(wrong, F.lit(True))  # one row each
    return both.select("posts", "overfull", "misplaced", (F.col("containers") == F.col("used")).alias("without_gaps"), (F.col("containers") <= F.col("least") * 1.01 + 1).alias("nearly_full"))


def common_words(spark: SparkSession, d: str) -> list[str]:
    """The function words, a small fixed table; more than the bound is an error further on."""
    rows = table(spark, d, "common_words").select("word").where(F.col("word").isNotNull()).distinct().limit(quality.MOST_COMMON_WORDS + 1).collect()
    return sorted(r["word"].lower() for r in rows)


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"), "doc_id", "text", common_words(spark, d))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that SQL can tell as well."""
    names = ["n_chars", "n_words", "n_lines", "mean_word_length", "letter_ratio", "digit_ratio", "common_share", "distinct_terms"]
    stats = quality.document_statistics(table(spark, d, "documents"), "doc_id", "text", common_words(spark, d), only=set(names))
    return stats.select("doc_id", *[F.round(n, 9).alias(n) for n in names])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    words, docs = common_words(spark, d), table(spark, d, "documents")
    rules = quality.fit_rules(docs, table(spark, d, "doc_labels"), "doc_id", "text", "label", words)
    return quality.classify(docs, "doc_id", "text", rules, words, without=quality.OTHER)


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups, "p8_found": p8_found, "p8_containers": p8_containers, "p8_loads": p8_loads, "p9_found": p9_found, "p9_stats": p9_stats, "p9_counts": p9_counts, "p2_found": p2_found, "p7_ids": p7_ids, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_quantiles": p4_quantiles}
