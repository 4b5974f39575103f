"""Streams end as tables in files, whatever the batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from histolith.streaming.pixels import run_to_table, stream_pixel_counts, stream_window_counts


@pytest.fixture
def molecules(spark, tmp_path):
    """Three files, whose pixels meet in part."""
    for i in range(3):
        spark.range(1000).select((F.col("id") % (10 + i) + 0.5).alias("x"), (F.col("id") % 7 - 3.0).alias("y")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.read.parquet(f"{tmp_path}/in")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("files", [1, 1000])
def test_counts_lie_in_files_and_not_in_the_driver(spark, tmp_path, molecules, files):
    stream = spark.readStream.schema(molecules.schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    out = run_to_table(spark, stream_pixel_counts(stream), "complete", "counts")
    assert rows(out) == rows(stream_pixel_counts(molecules)) and out.agg(F.sum("n")).first()[0] == 3000
    assert out.inputFiles() and out.dtypes == stream_pixel_counts(molecules).dtypes
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None


def test_the_query_ends_in_files(spark, data):
    from __spark_entry__ import queries

    assert queries()["stream01_pixel_counts"](spark, data).inputFiles()


def test_windows_of_all_batches_are_kept(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for i in range(4):  # ten days on with each file, so that the watermark closes the windows before
        at = [(start + timedelta(days=10 * i, minutes=20 * k), "ab"[k % 2]) for k in range(12)]
        spark.createDataFrame(at, "at timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = run_to_table(spark, stream_window_counts(stream, "at", "kind"), "append", "windows")
    closed = events.where(F.col("at") < F.lit(start + timedelta(days=30))).groupBy(F.date_trunc("hour", "at").alias("start"), "kind").agg(F.count(F.lit(1)).alias("n"))
    assert rows(out) == rows(closed) and out.count() == 24 and len({f.rsplit("/", 2)[1] for f in out.inputFiles()}) > 1


def test_a_stream_without_files_is_an_empty_table(spark, tmp_path, molecules):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(molecules.schema).parquet(f"{tmp_path}/none")
    out = run_to_table(spark, stream_pixel_counts(stream), "complete", "counts")
    assert out.count() == 0 and out.columns == ["px", "py", "n"]
