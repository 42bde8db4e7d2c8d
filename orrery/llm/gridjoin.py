"""Near-duplicates of embeddings: an epsilon grid order join, exact for every pair of one label.

Unit vectors of cosine c or more are at most EPS = sqrt(2 - 2c) apart. Vectors are turned onto the leading principal
directions and sorted, label by label, by their cells of a grid of width EPS in that order; the sorted sequence is cut into
blocks of BLOCK vectors. Intervals of blocks form a tree (FAN children each) whose nodes know the box of their leading
coordinates and a ball around their mean in all dimensions. Pairs of intervals are joined from the roots down:

* provably distant (boxes or balls more than EPS apart): skipped;
* provably close (no two members more than EPS apart): every pair is a link, counted by the sizes without being formed, so a
  group of near copies costs as many rows as it has blocks and nodes, not its square;
* else: the pairs of their children, and at the end pairs of blocks, compared in full by a matrix product.

The directions are fitted on SAMPLE vectors; any orthonormal directions give the same links, only more or fewer pairs of
blocks. Equal vectors of one label collapse to one class before all this. Blocks and nodes are rows of tables in the shared
folder; levels are joins of DataFrames; of a pair of blocks only counts per member and a spanning forest of its links
come back. Components are rounds of least labels (links.py). The driver sees counts and the sample.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components, and those of null labels, link
with nothing: n_links 0, themselves as component, kept. Vectors of different lengths never link. Repeated rows are vectors
of their own: they link with one another and with all that the others link with. A null vec_id takes part and counts; its
component is the least id reached, and it is kept only if there is none. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, bounded_batches
from orrery.llm.links import components

COSINE = 0.93
#: Vectors that fit the directions, and leading directions in use.
SAMPLE, LEADS = 4_000, 12
#: Vectors a block, children a node (as bits).
BLOCK, FAN = 512, 4
PLACE = 10
#: Bounds within this of the threshold decide nothing.
SLACK = 1e-9
NODE = "label string, dim int, node long, lo array<double>, hi array<double>, mean array<double>, radius double, size long, head long"


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length of vectors: orthonormal columns, the leading principal directions of the sample."""
    sample = classes.select("dim", "v").orderBy(F.xxhash64("c1"), "c2").limit(SAMPLE).collect()
    out = {}
    for d in {r["dim"] for r in sample}:
        x = units([r["v"] for r in sample if r["dim"] == d])
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEADS].copy()
    return out


def _turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    d = x.shape[1]
    return x @ axes[d] if d in axes else x[:, :LEADS]


def _gridded(batches: Iterator[pd.DataFrame], axes: dict[int, np.ndarray], eps: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        for _, part in b.groupby("dim"):
            x = units(part["v"])
            cells = np.floor(_turned(x, axes) / eps).astype(np.int32)
            yield part.drop(columns="v").assign(cells=list(cells), unit=[r.tobytes() for r in x])


def _cut(batches: Iterator[pd.DataFrame], part: int, axes: dict[int, np.ndarray], block: int) -> Iterator[pd.DataFrame]:
    """Blocks of a sorted partition: consecutive vectors of one label and length."""
    n, held = 0, None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        while len(held):
            same = (held["label"] == held["label"].iloc[0]) & (held["dim"] == held["dim"].iloc[0])
            run = len(held) if same.all() else int(np.argmin(same.to_numpy()))
            if run == len(held) and run < block:
                break
            yield _block(held[: min(run, block)], part, n, axes)
            held, n = held[min(run, block) :], n + 1
    if held is not None and len(held):
        yield _block(held, part, n, axes)


def _block(rows: pd.DataFrame, part: int, n: int, axes: dict[int, np.ndarray]) -> pd.DataFrame:
    x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
    at, mean = _turned(x, axes), x.mean(axis=0)
    row = {"label": rows["label"].iloc[0], "dim": rows["dim"].iloc[0], "part": part, "k": n, "lo": at.min(axis=0), "hi": at.max(axis=0), "mean": mean}
    row |= {"radius": sqrt(((x - mean) ** 2).sum(axis=1).max()), "size": int(rows["n"].sum()), "c1": list(rows["c1"]), "c2": list(rows["c2"]), "n": list(rows["n"]), "first": [None if pd.isna(i) else int(i) for i in rows["first"]], "units": x.tobytes()}
    return pd.DataFrame([row])


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes from lists of at most 2^FAN children."""
    for b in batches:
        out = []
        for label, dim, node, parts in zip(b["label"], b["dim"], b["node"], b["parts"]):
            means, weight = np.array([p["mean"] for p in parts]), np.array([p["size"] for p in parts], float)
            mean = (means * weight[:, None]).sum(axis=0) / weight.sum()
            radius = max(sqrt(((m - mean) ** 2).sum()) + p["radius"] for m, p in zip(means, parts))
            out.append((label, dim, node, np.min([p["lo"] for p in parts], axis=0), np.max([p["hi"] for p in parts], axis=0), mean, radius, int(weight.sum()), min(p["head"] for p in parts)))
        yield pd.DataFrame(out, columns=["label", "dim", "node", "lo", "hi", "mean", "radius", "size", "head"])


def _levels(stage: Staging, blocks: DataFrame) -> list[DataFrame]:
    """The tree's nodes, leaves first, up to one root for each label and length."""
    levels = [stage.keep(blocks.select("label", "dim", F.col("seq").alias("node"), "lo", "hi", "mean", "radius", "size", F.col("seq").alias("head")))]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top:
        top >>= FAN
        parts = F.collect_list(F.struct("lo", "hi", "mean", "radius", "size", "head")).alias("parts")
        grouped = levels[-1].groupBy("label", "dim", F.shiftright("node", FAN).alias("node")).agg(parts)
        levels.append(stage.keep(grouped.mapInPandas(_merged, NODE)))
    return levels


def _squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _judged(pairs: DataFrame, nodes: DataFrame, eps: float) -> DataFrame:
    """Pairs of nodes (label, dim, a, b) that aren't provably distant, with sizes, heads and whether they are provably close."""
    side = lambda s: nodes.select("label", "dim", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "mean", "radius", "size", "head")])
    both = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    both = both.withColumn("box", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))).withColumn("apart", F.sqrt(_squared("mean_a", "mean_b")))
    reach = F.col("radius_a") + F.col("radius_b")
    near = both.where((F.col("box") <= eps + SLACK) & (F.col("apart") - reach <= eps + SLACK))
    return near.select("label", "dim", "a", "b", "size_a", "size_b", "head_a", "head_b", (F.col("apart") + reach <= eps - SLACK).alias("close"))


def _children(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    below = nodes.select("label", "dim", F.shiftright("node", FAN).alias("up"), F.col("node").alias("x"))
    left = below.select("label", "dim", F.col("up").alias("a"), F.col("x").alias("ca"))
    right = below.select("label", "dim", F.col("up").alias("b"), F.col("x").alias("cb"))
    both = pairs.select("label", "dim", "a", "b").join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"])
    return both.where("ca <= cb").select("label", "dim", F.col("ca").alias("a"), F.col("cb").alias("b"))


def linked(ua: np.ndarray, ub: np.ndarray, cosine: float) -> np.ndarray:
    return ua @ ub.T >= cosine


def _joined(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Per pair of blocks and member with a link: how many vectors it adds, and the member that stands for its component there."""
    for batch in batches:
        for a, b, ua, ub, na, nb in zip(batch["a"], batch["b"], batch["units_a"], batch["units_b"], batch["n_a"], batch["n_b"]):
            x, y = (np.frombuffer(u, np.float64).reshape(len(n), -1) for u, n in ((ua, na), (ub, nb)))
            m = linked(x, y, cosine)
            if a == b:
                np.fill_diagonal(m, True)
            if not m.any():
                continue
            left, right = (a << PLACE) + np.arange(len(x)), (b << PLACE) + np.arange(len(y))
            top_x, top_y = left.copy(), right.copy()
            while True:
                # Each member takes the least of its partners on the other side, until nothing changes.
                new_x = np.minimum(top_x, np.where(m, top_y[None, :], top_x[:, None]).min(axis=1))
                new_y = np.minimum(top_y, np.where(m, new_x[:, None], top_y[None, :]).min(axis=0))
                if a == b:
                    new_x = new_y = np.minimum(new_x, new_y)
                if (new_x == top_x).all() and (new_y == top_y).all():
                    break
                top_x, top_y = new_x, new_y
            out = pd.DataFrame({"id": left, "more": m @ np.asarray(nb, np.int64), "top": top_x})
            if a != b:
                out = pd.concat([out, pd.DataFrame({"id": right, "more": m.T @ np.asarray(na, np.int64), "top": top_y})])
            yield out[out["more"] > 0]


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark, eps = vectors.sparkSession, sqrt(2 - 2 * cosine)
    bounded_batches(spark)
    stage = Staging(spark, "gridjoin")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("fit", F.col("label").isNotNull() & _valid(F.col("v"))).withColumn("c1", F.xxhash64("label", "v")).withColumn("c2", F.xxhash64("v", "label", F.lit(7)))
    classes = rows.where("fit").groupBy("label", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    classes = stage.keep(classes.withColumn("dim", F.size("v")))
    axes = _directions(classes)
    grid = classes.mapInPandas(lambda b: _gridded(b, axes, eps), "label string, c1 long, c2 long, n long, first long, dim int, cells array<int>, unit binary")
    blocks = _blocks(stage, stage.keep(grid), axes)
    levels = _levels(stage, blocks)
    close, open_pairs = _descended(stage, levels, eps)
    side = lambda s: blocks.select("label", "dim", F.col("seq").alias(s), F.col("units").alias(f"units_{s}"), F.col("n").alias(f"n_{s}"))
    both = open_pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"]).select("a", "b", "units_a", "units_b", "n_a", "n_b")
    met = stage.keep(both.mapInPandas(lambda b: _joined(b, cosine), "id long, more long, top long"))
    from_close, tied = _spread(stage, blocks, levels, close)
    members = blocks.select("label", "seq", F.posexplode(F.arrays_zip("c1", "c2", "n", "first")).alias("at", "m")).select("label", "seq", (F.shiftleft("seq", PLACE) + F.col("at")).alias("cid"), "m.*")
    members = stage.keep(members)
    edges = met.where("id <> top").select(F.col("id").alias("x"), F.col("top").alias("y"))
    edges = edges.unionByName(tied.where("x <> y")).unionByName(members.join(from_close.select("seq"), "seq", "left_semi").select(F.col("cid").alias("x"), F.shiftleft("seq", PLACE).alias("y")).where("x <> y"))
    labels = components(stage, stage.keep(members.select("cid", F.col("cid").alias("label"))), stage.keep(edges.distinct()))
    counts = met.groupBy(F.col("id").alias("cid")).agg(F.sum("more").alias("more"))
    known = members.join(counts, "cid", "left").join(from_close, "seq", "left").join(labels.select("cid", F.col("label").alias("root")), "cid")
    # A class meets itself among its partners: its own vectors, less the one that asks.
    known = known.select("label", "c1", "c2", "first", "root", (F.coalesce("more", F.lit(0)) + F.coalesce("whole", F.lit(0)) - 1).alias("n_links"))
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    known = stage.keep(known.join(least, "root").select("label", "c1", "c2", "n_links", "component", F.lit(True).alias("fit")))
    out = rows.drop("v").join(known, ["label", "c1", "c2", "fit"], "left")
    component = F.when(F.col("fit"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def _blocks(stage: Staging, grid: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """The sorted sequence in blocks, numbered (seq) so that neighbours in the sequence share the upper bits."""
    from pyspark import TaskContext

    order = ["label", "dim", "cells", "c1", "c2"]
    kind = "label string, dim int, part int, k int, lo array<double>, hi array<double>, mean array<double>, radius double, size long, c1 array<long>, c2 array<long>, n array<long>, first array<long>, units binary"
    size = BLOCK  # read here, not by the workers
    cut = grid.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(lambda b: _cut(b, TaskContext.get().partitionId(), axes, size), kind)
    blocks = stage.keep(cut)
    most = blocks.agg(F.max("k")).first()[0] or 0
    bits = -(-most.bit_length() // FAN) * FAN
    return blocks.withColumn("seq", F.shiftleft(F.col("part").cast("long"), bits) + F.col("k")).drop("part", "k")


def _descended(stage: Staging, levels: list[DataFrame], eps: float) -> tuple[DataFrame, DataFrame]:
    """From the roots down: the close pairs of nodes (with their level), and the pairs of blocks that must be compared."""
    found = []
    pairs = levels[-1].select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for depth in range(len(levels) - 1, -1, -1):
        judged = stage.keep(_judged(pairs, levels[depth], eps))
        found.append(judged.where("close").withColumn("level", F.lit(depth)).drop("close"))
        pairs = judged.where("not close")
        if depth:
            pairs = stage.keep(_children(pairs, levels[depth - 1]))
    close = found[0]
    for f in found[1:]:
        close = close.unionByName(f)
    return close, pairs.select("label", "dim", "a", "b")


def _spread(stage: Staging, blocks: DataFrame, levels: list[DataFrame], close: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, whole): what close pairs of nodes add to each member of a block; and the links (x, y) that tie blocks to nodes and
    nodes to one another. Members of a close node are all of one component, as the partner is linked with each."""
    sides = close.select("label", "dim", "level", F.col("a").alias("node"), F.col("size_b").alias("more"), F.col("head_a").alias("head"))
    sides = sides.unionByName(close.where("a <> b").select("label", "dim", "level", F.col("b").alias("node"), F.col("size_a").alias("more"), F.col("head_b").alias("head")))
    sides = stage.keep(sides.groupBy("label", "dim", "level", "node").agg(F.sum("more").alias("more"), F.min("head").alias("head")))
    above = F.explode(F.array(*[F.struct(F.lit(t).alias("level"), F.shiftright("seq", FAN * t).alias("node")) for t in range(len(levels))])).alias("up")
    under = stage.keep(blocks.select("label", "dim", "seq", above).select("label", "dim", "seq", "up.*").join(sides, ["label", "dim", "level", "node"]).select("seq", "more", "head"))
    at = lambda c: F.shiftleft(c, PLACE)
    tied = under.select(at("seq").alias("x"), at("head").alias("y")).unionByName(close.select(at("head_a").alias("x"), at("head_b").alias("y")))
    return under.groupBy("seq").agg(F.sum("more").alias("whole")), tied


def keep_first(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The vectors that stay, with all their columns: one of each group of near-duplicates."""
    gone = near_vectors(vectors, cosine).where("not kept").select(F.col("vec_id").alias("gone")).distinct()
    gone = Staging(vectors.sparkSession, "gone").keep(gone)
    return vectors.join(gone, vectors["vec_id"] == gone["gone"], "left_anti")


#: The same as SQL, over all pairs of a label.
SQL = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT rid, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT rid AS x, rid AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y), c AS (SELECT r.x, min(vec_id) AS component_id FROM r JOIN v ON v.rid = r.y GROUP BY 1), k AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept FROM v JOIN c ON c.x = v.rid LEFT JOIN k ON k.x = v.rid"""
