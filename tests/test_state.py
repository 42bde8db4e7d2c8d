"""Streams whose state forgets: by age, by size, and across a restart."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.streaming import state as st

SCHEMA = "event_id long, k string, ts timestamp"


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes one file a batch; returns the stream over them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKS)
    folder = tmp_path / "in"
    folder.mkdir()

    def put(n, rows):
        d = pd.DataFrame(rows, columns=["event_id", "k", "ts"])
        d["ts"] = pd.to_datetime(d["ts"], utc=True)
        spark.createDataFrame(d, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    put.stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(folder))
    yield put
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def started(df, mode, name, check):
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(check)).start()


def test_history_forgets_by_age_and_size(spark, feed, tmp_path):
    q = started(st.recent_stream(feed.stream(), "k", 3600, 3, "0 seconds"), "update", "recent", tmp_path / "c")
    try:
        feed(0, [(i, "a", f"2024-01-01 00:0{i}:00") for i in range(5)] + [(9, "b", "2024-01-01 00:00:00")])
        q.processAllAvailable()
        got = {r.k: list(r.ids) for r in spark.table("recent").collect()}
        assert got == {"a": ["4", "3", "2"], "b": ["9"]}  # the oldest beyond the cap are gone
        feed(1, [(20, "a", "2024-01-01 01:03:00")])
        q.processAllAvailable()
        feed(2, [(30, "c", "2024-01-01 05:00:00")])  # the watermark passes all others
        q.processAllAvailable()
        last = {}
        for r in spark.table("recent").collect():
            last[r.k] = list(r.ids)
        assert last["b"] == [] and last["a"] == [] and last["c"] == ["30"]
    finally:
        q.stop()


def test_old_events_leave_while_new_ones_stay(spark, feed, tmp_path):
    q = started(st.recent_stream(feed.stream(), "k", 3600, 100, "0 seconds"), "update", "aging", tmp_path / "c")
    try:
        for n, rows in enumerate([[(1, "a", "2024-01-01 00:00:00")], [(2, "a", "2024-01-01 00:50:00")], [(3, "b", "2024-01-01 01:20:00")], [(4, "b", "2024-01-01 01:21:00")]]):
            feed(n, rows)
            q.processAllAvailable()
        last = {}
        for r in spark.table("aging").collect():
            last[r.k] = list(r.ids)
        assert last["a"] == ["2"] and sorted(last["b"]) == ["3", "4"]
    finally:
        q.stop()


def test_repeats_are_dropped_across_a_restart_and_pass_after_their_time(spark, feed, tmp_path):
    def run():
        d = st.first_seen_stream(feed.stream(), ["k"], 3600, late="0 seconds", shards=4)
        q = d.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    feed(0, [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")])
    assert run() == {1, 3}
    feed(1, [(4, "a", "2024-01-01 00:30:00"), (5, "c", "2024-01-01 00:31:00")])
    assert run() == {1, 3, 5}
    feed(2, [(6, "a", "2024-01-01 01:30:00"), (7, "a", "2024-01-01 01:31:00")])
    assert run() == {1, 3, 5, 6}


def test_a_full_shard_forgets_its_oldest(spark, feed, tmp_path):
    q = started(st.first_seen_stream(feed.stream(), ["k"], 10**6, cap=4, keep=2, shards=1, late="0 seconds"), "append", "full", tmp_path / "c")
    try:
        feed(0, [(i, f"k{i}", f"2024-01-01 00:0{i}:00") for i in range(5)])
        q.processAllAvailable()
        feed(1, [(10, "k0", "2024-01-01 00:10:00"), (11, "k4", "2024-01-01 00:11:00")])
        q.processAllAvailable()
        assert {r.event_id for r in spark.table("full").collect()} == {0, 1, 2, 3, 4, 10}
    finally:
        q.stop()


def test_streams_equal_their_batch_twins(spark, feed, tmp_path):
    rows = [(i, f"k{i % 7}", str(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=13 * i + i * i % 11))) for i in range(120)]
    q = started(st.first_seen_stream(feed.stream(), ["k"], 7200, late="1 hour", shards=3), "append", "twin", tmp_path / "c")
    try:
        for n in range(0, 120, 30):
            feed(n, rows[n : n + 30])
            q.processAllAvailable()
        batch = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "k", "ts"]).astype({"ts": "datetime64[us]"}), SCHEMA)
        want = {r.event_id for r in st.first_seen(batch, ["k"], 7200).collect()}
        assert {r.event_id for r in spark.table("twin").collect()} == want and 0 < len(want) < 120
    finally:
        q.stop()


def test_the_provider_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        st.recent_stream(spark.createDataFrame([], SCHEMA).withColumn("event_id", F.col("event_id")), "k", 60, 3)
