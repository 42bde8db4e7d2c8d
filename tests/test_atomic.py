"""Several tables as one batch: all or nothing, once, across failures and repeats."""

import os

import pytest
from pyspark.sql import functions as F

from orrery.sources import atomic

ROWS = "k int, v string"


def tables(spark, *rows):
    d = spark.createDataFrame(rows, ROWS)
    return {"a": d, "b": d.withColumn("v", F.upper("v"))}


def seen(spark, root, table="a"):
    return sorted((r.k, r.v, r.batch) for r in atomic.read(spark, root, table, ROWS).collect())


def test_batches_appear_whole_and_once(spark, tmp_path):
    root = str(tmp_path / "t")
    assert seen(spark, root) == []
    assert atomic.publish(tables(spark, (1, "x")), root, 0) and atomic.publish(tables(spark, (2, "y")), root, 1, {"watermark": "7"})
    assert not atomic.publish(tables(spark, (9, "again")), root, 1)
    assert seen(spark, root) == [(1, "x", 0), (2, "y", 1)] and seen(spark, root, "b") == [(1, "X", 0), (2, "Y", 1)]
    assert atomic.note(spark, root, "watermark") == "7" and seen(spark, root, "none") == []


def test_a_run_that_dies_between_tables_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    atomic.publish(tables(spark, (1, "x")), root, 0)
    broken = tables(spark, (2, "y"))
    broken["b"] = broken["b"].withColumn("v", F.raise_error(F.lit("dies here")).cast("string"))
    with pytest.raises(Exception, match="dies here"):
        atomic.publish(broken, root, 1)
    assert seen(spark, root) == [(1, "x", 0)] and len(os.listdir(f"{root}/data")) == 2
    assert atomic.vacuum(spark, root) == 1 and len(os.listdir(f"{root}/data")) == 1
    assert atomic.publish(tables(spark, (2, "z")), root, 1) and seen(spark, root) == [(1, "x", 0), (2, "z", 1)]


def test_a_claim_left_by_a_dead_run_stops_nobody(spark, tmp_path):
    root = str(tmp_path / "t")
    os.makedirs(f"{root}/manifests")
    open(f"{root}/manifests/_{0:012d}.claim", "w").close()
    assert atomic.publish(tables(spark, (1, "x")), root, 0) and seen(spark, root) == [(1, "x", 0)]


def test_stream_batches_that_are_repeated_change_nothing(spark, tmp_path):
    root, src = str(tmp_path / "t"), str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, f"v{k}")], ROWS).coalesce(1).write.mode("append").parquet(src)
    write = atomic.sink(root, lambda d: {"a": d, "b": d.withColumn("v", F.upper("v"))})
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    before = seen(spark, root)
    assert [r[0] for r in before] == [0, 1, 2] and len({r[2] for r in before}) == 3
    write(spark.createDataFrame([(7, "late")], ROWS), 1)  # the same batch once more, as after a lost commit
    assert seen(spark, root) == before


def test_graph_sync_takes_only_what_is_new(spark, tmp_path):
    root, kind = str(tmp_path / "g"), "id string, name string, parent string, updated long"
    nodes = lambda d: d.select("id", "name")
    edges = lambda d: d.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    rows = [("a", "A", None, 1), ("b", "B", "a", 2)]
    assert atomic.sync_graph(spark.createDataFrame(rows, kind), root, "updated", nodes, edges)
    assert not atomic.sync_graph(spark.createDataFrame(rows, kind), root, "updated", nodes, edges)
    assert atomic.sync_graph(spark.createDataFrame([("a", "A2", None, 5), ("b", "B", "a", 2)], kind), root, "updated", nodes, edges)
    assert {(r.id, r.name) for r in atomic.current(spark, root, "nodes", "id string, name string", ["id"]).collect()} == {("a", "A2"), ("b", "B")}
    assert [(r.src, r.dst) for r in atomic.current(spark, root, "edges", "src string, dst string", ["src", "dst"]).collect()] == [("b", "a")]
    assert atomic.note(spark, root, "watermark") == "5"
