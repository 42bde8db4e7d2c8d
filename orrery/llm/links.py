"""Components of links among items that share keys, without emitting all pairs of a key.

Items come as `shared` rows (key, cid); a caller's `confirm` keeps the pairs (x, y) that are truly linked. Work goes in
levels. On each one, star rounds compare all items under a key with one pivot of the key: first the item that shares most
with all others, in later rounds any; pairs that many keys have in common count once. Confirmed links join components.

What stays apart is then sorted by *where it differs from the pivot*: two linked items, compared with one and the same
pivot, differ from it in the same place. The caller's `differ` turns (pivot, cid) into rows under finer keys, such that
linked items of one key and pivot meet under a finer key again. So variants of one item that have nothing to do with one
another part, however many they are. The next level works on these finer keys, and so on while the keys hold many more
pairs than there are items; at the end all pairs of items of different components under a key are compared, where `fits`
allows. Pairs within one component need no comparison, so the components are exactly those of all links, with no cap.
Rows under a key meet in joins that split hot keys, or in aggregates with partial sums; all tables of a round are in the
shared folder, and only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, shuffles_end

STARS, DEPTH = 4, 3
#: Pairs an item, on average, up to which all pairs under the keys of several components are formed: those that are compared
#: as they come, and CHEAP times as many where `fits` is asked first.
ROOMY, CHEAP = 4, 50


def link(stage: Staging, shared: DataFrame, items: DataFrame, confirm: Callable[[DataFrame], DataFrame], differ: Callable[[DataFrame], DataFrame], fits: str = "true", stars: int = STARS, roomy: float = ROOMY) -> DataFrame:
    """(cid, label) for all `items` (cid): label is the least cid of the component.

    differ: rows (key, cid, ...) of finer keys from the pairs (pivot, cid) of a level, linked to the pivot or not;
    fits: a condition on its further columns, which carry _x and _y for the two items of a pair.
    """
    labels, n = stage.keep(items.select("cid", F.col("cid").alias("label"))), items.count()
    for depth in range(DEPTH + 1):
        rows = stage.keep(_ranked(shared))
        for r in range(max(1, stars)):
            more = stage.keep(confirm(_stars(rows, labels, r)))
            found = more.count()
            labels = _joined(stage, labels, more)
            if found * 20 < n:
                break
            rows = _open(stage, rows, labels)
        crowd = rows.join(labels, "cid").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
        with shuffles_end(stage.spark):
            pairs = crowd.agg(F.sum(F.expr("m * (m - 1) / 2"))).first()[0] or 0
        if depth == DEPTH or pairs <= roomy * n * (CHEAP if depth else 1):
            break
        shared = stage.keep(differ(_against(rows, labels)))
    if pairs:
        labels = _joined(stage, labels, stage.keep(confirm(_rest(rows.drop("degree"), labels, fits if depth else "true"))))
    return labels


def _open(stage: Staging, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows under keys that still hold several components; what is settled is not carried through further rounds."""
    mixed = rows.select("key", "cid").join(labels, "cid").groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    left = stage.keep(rows.join(mixed, "key", "left_semi"))
    stage.drop(rows)
    return left


def _joined(stage: Staging, labels: DataFrame, links: DataFrame) -> DataFrame:
    if links.isEmpty():
        stage.drop(links)
        return labels
    fresh = components(stage, labels, links)
    stage.drop(labels, links)
    return fresh


def _ranked(shared: DataFrame) -> DataFrame:
    """The rows with each item's degree: how many items it meets under all its keys."""
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    degrees = shared.select("key", "cid").join(sizes, "key").groupBy("cid").agg(F.sum("size").alias("degree"))
    return shared.join(degrees, "cid")


def _pivots(rows: DataFrame, r: int) -> DataFrame:
    """(key, pivot, other) of the keys that hold several components: the pivot of round r and its label."""
    order = F.struct((-F.col("degree")).alias("d"), F.xxhash64("cid").alias("h"), F.col("cid").alias("pivot"), F.col("label").alias("other")) if r == 0 else F.struct(F.xxhash64("cid", F.lit(r)).alias("h"), F.col("cid").alias("pivot"), F.col("label").alias("other"))
    return rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min(order).alias("p")).where("a < b").select("key", "p.pivot", "p.other")


def _stars(rows: DataFrame, labels: DataFrame, r: int) -> DataFrame:
    """Pairs of each item with the key's pivot of the round, where their components differ."""
    rows = rows.select("key", "cid", "degree").join(labels, "cid")
    return rows.join(_pivots(rows, r), "key").where("label <> other").select(F.least("cid", "pivot").alias("x"), F.greatest("cid", "pivot").alias("y")).distinct()


def _against(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(pivot, cid) of all items under keys of several components, the pivots themselves too."""
    rows = rows.select("key", "cid", "degree").join(labels, "cid")
    return rows.join(_pivots(rows, 0), "key").select("pivot", "cid").distinct()


def _rest(rows: DataFrame, labels: DataFrame, fits: str) -> DataFrame:
    """All pairs of items of different components under a common key that fit."""
    more = [c for c in rows.columns if c not in ("key", "cid")]
    rows = rows.join(labels, "cid")
    mixed = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    left = rows.select("key", F.col("cid").alias("x"), F.col("label").alias("lx"), *[F.col(c).alias(f"{c}_x") for c in more])
    right = rows.select("key", F.col("cid").alias("y"), F.col("label").alias("ly"), *[F.col(c).alias(f"{c}_y") for c in more])
    return left.join(right, "key").where("x < y and lx <> ly").where(fits).select("x", "y").distinct()


def components(stage: Staging, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links: the least label that each item reaches, over `labels` (cid, label) that hold already."""
    at = labels.select(F.col("cid").alias("x"), F.col("label").alias("lx"))
    to = labels.select(F.col("cid").alias("y"), F.col("label").alias("ly"))
    edges = stage.keep(links.join(at, "x").join(to, "y").where("lx <> ly").select(F.col("lx").alias("u"), F.col("ly").alias("v")).distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    parents = stage.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
    while True:
        # Each node takes the least parent around it, or its parent's parent: one table a round, which also tells what has moved.
        near = both.join(parents.select(F.col("u").alias("v"), F.col("p").alias("q")), "v").groupBy("u").agg(F.min("q").alias("q"))
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        now = stage.keep(parents.select("u", "p").join(near, "u").join(above, "p").select("u", F.least("p", "q", "pp").alias("p"), (F.least("q", "pp") < F.col("p")).alias("moved")))
        stage.drop(parents)
        parents = now
        if now.where("moved").isEmpty():
            break
    out = stage.keep(labels.join(parents.select(F.col("u").alias("label"), "p"), "label", "left").select("cid", F.coalesce("p", "label").alias("label")))
    stage.drop(edges, parents)
    return out
