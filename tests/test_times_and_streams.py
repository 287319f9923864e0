from datetime import UTC, datetime

import os
import pytest
from pyspark.sql import functions as F

from graphloom.functions import timeparse
from graphloom.streaming import incremental

NOW = int(datetime(2025, 6, 18, 12, tzinfo=UTC).timestamp() * 1000)  # a Wednesday


def day(*ymd):
    return int(datetime(*ymd, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "start", "end", "confidence", "rest"),
    [
        ("what broke on 2025-03-04?", day(2025, 3, 4), day(2025, 3, 5), 0.9, "what broke on ?"),
        ("plans in March 2024", day(2024, 3, 1), day(2024, 4, 1), 0.8, "plans"),
        ("Q4 2023 numbers", day(2023, 10, 1), day(2024, 1, 1), 0.8, "numbers"),
        ("seen two weeks ago", day(2025, 6, 2), day(2025, 6, 9), 0.75, "seen"),
        ("last week", day(2025, 6, 9), day(2025, 6, 16), 0.85, ""),
        ("yesterday and today", day(2025, 6, 17), day(2025, 6, 19), 0.9, "and"),
        ("2024年5月 的报告", day(2024, 5, 1), day(2024, 6, 1), 0.8, "的报告"),
        ("3 years ago", day(2022, 1, 1), day(2023, 1, 1), 0.6, ""),
    ],
)
def test_time_expressions(text, start, end, confidence, rest):
    assert timeparse.parse(text, NOW) == (start, end, confidence, rest)


def test_no_time():
    assert timeparse.parse("nothing to see on 2025-13-40", NOW) is None


def test_mentioned_times_of_a_table(spark):
    df = spark.createDataFrame([(1, "on 2025-01-02"), (2, None), (3, "never")], "id long, text string")
    assert [r.id for r in timeparse.mentioned_times(df, id_col="id", text_col="text", now_ms=NOW).collect()] == [1]


@pytest.fixture
def source(spark, tmp_path):
    rows = [(1, "a", 1, "2024-01-01 00:10:00"), (2, "a", 2, "2024-01-01 00:50:00"), (3, "b", 3, "2024-01-01 01:10:00"), (4, "a", 4, "2024-01-01 02:00:00"), (5, None, 5, None)]
    df = spark.createDataFrame(rows, "event_id long, user string, value long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(5):  # a file each, so that batches differ
        df.where(f"event_id = {k + 1}").coalesce(1).write.parquet(f"{tmp_path}/events.parquet/{k}")
    # a folder of folders is read as one table by a stream, and by a plain read of its files
    return str(tmp_path)


def stream(spark, folder):
    schema = "event_id long, user string, value long, ts timestamp_ntz"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet")


def test_upserts_over_batches(spark, rows, source):
    assert rows(incremental.upsert_stream(stream(spark, source), "user", ["ts", "event_id"], "t"), "user", "event_id") == [("a", 4), ("b", 3)]


def test_windows(spark, rows, source):
    got = incremental.windowed_counts(stream(spark, source).where("ts is not null"), "ts", "1 hour", "1 day", ["user"], "t")
    assert sorted((r.user, r.start.hour, r.n) for r in got.collect()) == [("a", 0, 2), ("a", 2, 1), ("b", 1, 1)]


def test_last_n_is_kept_between_batches(spark, rows, source):
    assert rows(incremental.last_n(stream(spark, source), "user", "value", "ts", 2, "t"), "user", "value") == [("a", 2), ("a", 4), ("b", 3)]


def test_change_sets(spark, rows):
    nodes = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, file_path string")
    changes = spark.createDataFrame([("a", "M"), ("b", "D")], "file_path string, status string")
    fresh = spark.createDataFrame([("9", "a"), ("8", "b")], "id string, file_path string")
    assert rows(incremental.apply_changes(nodes, changes, fresh), "id", "file_path") == [("3", "c"), ("9", "a")]
    assert rows(incremental.skip_done(nodes, spark.createDataFrame([("1",)], "id string"), "id"), "id") == [("2",), ("3",)]


def test_an_upsert_goes_on_where_it_stopped(spark, rows, source, tmp_path):
    folder, schema = str(tmp_path / "run"), "event_id long, user string, value long, ts timestamp_ntz"
    assert rows(incremental.upsert_stream(stream(spark, source), "user", ["ts", "event_id"], "t", folder=folder, buckets=4), "user", "event_id") == [("a", 4), ("b", 3)]
    before = incremental.versions(spark, f"{folder}/data")
    more = spark.createDataFrame([(9, "b", 9, "2024-02-01 00:00:00"), (8, "c", 8, "2024-02-01 00:00:00")], "event_id long, user string, value long, ts string")
    more.withColumn("ts", more.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(f"{source}/events.parquet/9")
    assert rows(incremental.upsert_stream(stream(spark, source), "user", ["ts", "event_id"], "t", folder=folder, buckets=4), "user", "event_id") == [("a", 4), ("b", 9), ("c", 8)]
    after = incremental.versions(spark, f"{folder}/data")
    assert after[: len(before)] == before and len(after) == len(before) + 1
    # a version that wasn't finished doesn't count
    os.makedirs(f"{folder}/data/version=99/bucket=0")
    assert incremental.versions(spark, f"{folder}/data") == after
    assert incremental.current(spark, f"{folder}/data", spark.createDataFrame([], schema).schema, below=0) is None
