"""Several tables written as one: all of a batch becomes visible, or nothing.

Each attempt writes its tables to a folder of its own; then one manifest, which names them, is put in place by a rename that
fails if the batch has one already. Readers take only what manifests name. So a run that dies between tables leaves
nothing visible, a repeated batch changes nothing, and of two runs of one batch one wins. Manifests carry notes, such as the
watermark up to which a sync has come, so the note and the rows can't disagree.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.store import latest


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """What has been published, by batch: {batch, tables: {name: folder}, note}."""
    path, fs = _fs(spark, root)
    folder = path(f"{root}/manifests")
    if not fs.exists(folder):
        return []
    rows = spark.read.text(f"{root}/manifests", pathGlobFilter="*.json").collect()
    return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["batch"])


def publish(tables: dict[str, DataFrame], root: str, batch: int, note: dict | None = None) -> bool:
    """Writes all tables as one batch; False if the batch was there."""
    spark = next(iter(tables.values())).sparkSession
    path, fs = _fs(spark, root)
    done = path(f"{root}/manifests/{batch:012d}.json")
    if fs.exists(done):
        return False
    attempt = f"{root}/data/{batch:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{attempt}/{name}")
    made = {"batch": batch, "tables": {name: f"{attempt}/{name}" for name in tables}, "note": note or {}}
    ready = path(f"{root}/manifests/_{uuid.uuid4().hex}")
    fs.mkdirs(path(f"{root}/manifests"))
    out = fs.create(ready, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    # Neither a rename nor an exists() alone is enough where a rename replaces: the target is claimed by creating it.
    claim = path(f"{root}/manifests/_{batch:012d}.claim")
    if not fs.createNewFile(claim) and fs.exists(done):
        fs.delete(ready, False)
        return False
    if not fs.rename(ready, done):
        fs.delete(ready, False)
        return False
    return True


def read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """All published rows of a table, with the number of their batch."""
    parts = [(m["batch"], m["tables"][table]) for m in manifests(spark, root) if table in m["tables"]]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    d = spark.read.schema(schema).parquet(*[p for _, p in parts])
    return d.withColumn("batch", F.regexp_extract(F.input_file_name(), "/data/([0-9]{12})-", 1).cast("long"))


def note(spark: SparkSession, root: str, key: str):
    """The last note of that name."""
    found = [m["note"][key] for m in manifests(spark, root) if key in m["note"]]
    return found[-1] if found else None


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes what no manifest names: the leftovers of runs that died. Not while a batch is being written."""
    path, fs = _fs(spark, root)
    used = {"/".join(t.split("/")[:-1]).rsplit("/", 1)[-1] for m in manifests(spark, root) for t in m["tables"].values()}
    gone = 0
    if fs.exists(path(f"{root}/data")):
        for s in fs.listStatus(path(f"{root}/data")):
            if s.getPath().getName() not in used:
                gone += bool(fs.delete(s.getPath(), True))
    return gone


def sink(root: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch as one atomic batch of several tables, exactly once however often it is repeated."""

    def write(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            publish(split(kept), root, batch)
        finally:
            kept.unpersist()

    return write


def sync_graph(rows: DataFrame, root: str, updated: str, nodes: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame], DataFrame]) -> bool:
    """Relational rows into a graph (nodes, edges), incrementally: only those updated after the last published watermark, which
    is the greatest value seen. Both tables and the new watermark appear together. False if there was nothing new."""
    spark = rows.sparkSession
    since = note(spark, root, "watermark")
    new = rows if since is None else rows.where(F.col(updated) > F.lit(since).cast(rows.schema[updated].dataType))
    last = new.agg(F.max(updated).cast("string")).first()[0]
    if last is None:
        return False
    batch = max((m["batch"] for m in manifests(spark, root)), default=-1) + 1
    return publish({"nodes": nodes(new), "edges": edges(new)}, root, batch, {"watermark": last})


def current(spark: SparkSession, root: str, table: str, schema: str, keys: list[str]) -> DataFrame:
    """The graph's state: of each key the row of the last batch."""
    d = read(spark, root, table, schema)
    return latest(d, keys, ["batch"]).drop("batch")
