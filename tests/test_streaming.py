"""Stream forms give what the batch forms give, over the events table dealt out in small files."""

import pytest
from pyspark.sql import functions as F

from orrery.streaming import events as ev

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.mode("overwrite").parquet(path)
    return path


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def streamed(spark, path):
    batch = spark.read.parquet(path)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(path)


def test_windows_equal_batch(spark, stream_dir):
    batch, stream = streamed(spark, stream_dir)
    got = run(spark, ev.tumbling(stream, "6 hours"), "complete", "windows")
    key = lambda d: sorted((r.start, r.event_type, r.n) for r in d.collect())
    assert key(got) == key(ev.tumbling(batch, "6 hours"))


def test_latest_per_key_equals_batch(spark, stream_dir):
    batch, stream = streamed(spark, stream_dir)
    got = run(spark, ev.latest_per_key(stream), "complete", "latest")
    assert {(r.event_type, r.event_id) for r in got.collect()} == {(r.event_type, r.event_id) for r in ev.latest_per_key(batch).collect()}


def test_last_n_state_is_bounded_and_equals_batch(spark, stream_dir):
    batch, stream = streamed(spark, stream_dir)
    last = {}
    for r in run(spark, ev.last_n_stream(stream, 3), "update", "last_n").collect():
        last[r.user_id] = max(last.get(r.user_id, []), r.ids)
    want = {}
    for r in ev.last_n(batch, 3).collect():
        want.setdefault(r.user_id, []).append(r.event_id)
    assert {k: sorted(v) for k, v in last.items()} == {k: sorted(v) for k, v in want.items()}


def test_dedup_within_watermark(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "event_id long, title string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/d")
    _, stream = streamed(spark, f"{tmp_path}/d")
    got = run(spark, ev.dedup(stream, ["title"], "10 minutes"), "append", "deduped")
    assert sorted(r.title for r in got.collect()) == ["a", "b"]


def test_dead_letters_hold_bad_and_null_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, value double")
    good, dead = ev.split_dead_letters(df, F.col("value") > 0)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in dead.collect()) == [2, 3]
