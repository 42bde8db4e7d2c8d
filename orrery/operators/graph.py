"""Graph operators on nodes (id, kind) and directed edges (src, dst, kind). Loops are joins over written tables: a table in
the session's shared folder cuts the plan each round, so neither plan nor lineage grows."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; only a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = _own_folder(spark.sparkContext.applicationId)
    return found.rstrip("/")


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="orrery-")


def cut(df: DataFrame) -> DataFrame:
    """The rows from a table written to the shared folder: no lineage, one computation, and a size that joins can go by."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): undirected degree over the largest one."""
    d = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    most = d.agg(F.max("degree").alias("most"))
    return d.join(F.broadcast(most)).withColumn("centrality", F.col("degree") / F.col("most")).drop("most")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5, weight: bool = False) -> DataFrame:
    """(id, rank) after a fixed number of rounds over distinct edges; ranks of sinks are spread over all nodes."""
    e = edges.select("src", "dst").distinct()
    nodes = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    e = cut(e.join(out, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    sinks = nodes.join(out.select(F.col("src").alias("id")), "id", "left_anti").select("id")
    for k in range(rounds):
        lost = ranks.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = e.join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = nodes.join(sent, F.col("id") == F.col("to"), "left").join(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % every == every - 1:
            ranks = cut(ranks)
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id each node reaches, by least neighbours and pointer jumping until nothing changes."""
    both = cut(undirected(edges))
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", F.least("label", "m").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        now = cut(step.join(jump, "label", "left").select("id", F.coalesce("next", "label").alias("label")))
        changed = now.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").limit(1).count()
        labels = now
        if not changed:
            return labels.withColumnRenamed("label", "component")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): synchronous rounds of the most frequent neighbour label, the least one of equals."""
    both = cut(undirected(edges))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label")))
    return labels


def reach(edges: DataFrame, start: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(start, id, distance) within `depth` hops of each start (column id): the frontier less what is seen, round by round."""
    e = edges.select("src", "dst").distinct() if directed else undirected(edges)
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    front = seen
    for k in range(1, depth + 1):
        new = front.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = cut(new.withColumn("distance", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 6, directed: bool = True) -> DataFrame:
    """(a, b, distance) of the pairs (a, b) within `depth` hops."""
    found = reach(edges, pairs.select(F.col("a").alias("id")).distinct(), depth, directed)
    return pairs.join(found.select(F.col("start").alias("a"), F.col("id").alias("b"), "distance"), ["a", "b"])


def all_paths(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """(a, b, path) of every directed simple path of up to `depth` edges."""
    e = edges.select("src", "dst").distinct()
    front, out = pairs.select("a", "b", F.array("a").alias("path")), None
    for _ in range(depth):
        front = front.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("a", "b", F.array_append("path", F.col("dst")).alias("path"))
        done = front.where(F.element_at("path", -1) == F.col("b"))
        out = done if out is None else out.unionByName(done)
        front = front.where(F.element_at("path", -1) != F.col("b"))
    return out


def neighbours(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, neighbour, direction): both ends of an edge in two equi-joins, not one with OR."""
    e = edges.where(F.col("kind") == kind) if kind else edges
    out = nodes.join(e, F.col("id") == F.col("src")).select("id", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionByName(nodes.join(e, F.col("id") == F.col("dst")).select("id", F.col("src").alias("neighbour"), F.lit("in").alias("direction")))


def similarity(edges: DataFrame, least: float = 0.7, k: int = 10) -> DataFrame:
    """(a, b, common, jaccard, adamic_adar, position): the k most similar nodes of each, of a Jaccard similarity of `least` or more.

    A set join with a prefix filter: two neighbour sets of that similarity share one of the n - ceil(least n) + 1 neighbours
    of least degree of either, so hubs join nothing unless a node has little else; sizes differ by the factor `least` at most,
    and what lies behind the shared place must leave room for the rest. Full sets are compared for the pairs left.
    """
    e = undirected(edges)
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    near = e.join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("d")), "dst")
    ordered = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d", "dst"))).alias("s"))
    sets = cut(ordered.select("src", F.xxhash64("src").alias("h"), F.col("s.dst").alias("s"), F.size("s").alias("n")))
    front = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    # By hash: what is shuffled is small, and a collision only adds a candidate.
    keys = sets.select("h", "n", F.posexplode(front).alias("at", "x")).select("h", "n", "at", F.xxhash64("x").alias("key"))
    left, right = keys.toDF("ha", "na", "ia", "key"), keys.toDF("hb", "nb", "ib", "key")
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    fits = (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (room * (1 + least) >= least * (F.col("na") + F.col("nb")) - 1e-9)
    pairs = left.join(right, "key").where("ha < hb").where(fits).select("ha", "hb").distinct()
    sa, sb = sets.select(F.col("h").alias("ha"), F.col("src").alias("x"), F.col("s").alias("sx")), sets.select(F.col("h").alias("hb"), F.col("src").alias("y"), F.col("s").alias("sy"))
    both = pairs.join(sa, "ha").join(sb, "hb").withColumn("c", F.array_intersect("sx", "sy"))
    both = cut(both.select("x", "y", "c", F.size("c").cast("long").alias("common"), (F.size("c") / (F.size("sx") + F.size("sy") - F.size("c"))).alias("jaccard")).where(F.col("jaccard") >= least - 1e-12))
    rare = both.select("x", "y", F.explode("c").alias("src")).join(deg.where("deg > 1"), "src").groupBy("x", "y").agg(F.sum(1 / F.log(F.col("deg").cast("double"))).alias("adamic_adar"))
    both = both.drop("c").join(rare, ["x", "y"], "left").withColumn("adamic_adar", F.coalesce("adamic_adar", F.lit(0.0)))
    each = both.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p"), "common", "jaccard", "adamic_adar").select("p.*", "common", "jaccard", "adamic_adar")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("jaccard", 9)), "b")
    return each.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


#: Nodes of a block, whose pairs with another block one task counts in a table of so many squared.
PAIR_BLOCK = 1500


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, common, jaccard, adamic_adar) of all pairs a < b of nodes with a common neighbour.

    No pair is left out, so the rows grow with the squares of the degrees; `similarity` is for large graphs. Nodes go to blocks
    by ranges of their ids, and each pair of blocks is a row with the neighbours of both, which a task counts and returns piece
    by piece: pairs are never shuffled. Neighbours are known by 64-bit hashes.
    """
    e = cut(undirected(edges))
    nodes = cut(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")))
    n = nodes.count()
    blocks = max(1, -(-n // PAIR_BLOCK))
    dealt = cut(nodes.repartitionByRange(blocks, "id").withColumn("block", F.spark_partition_id()))
    near = e.join(nodes.where("deg > 1").select(F.col("id").alias("dst"), F.col("deg").alias("dv")), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct(F.xxhash64("dst").alias("v"), F.col("dv"))).alias("near"))
    one = dealt.join(near, "id").select("block", F.struct("id", "deg", F.col("near.v").alias("v"), F.col("near.dv").alias("dv")).alias("x"))
    packed = cut(one.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x")))
    left, right = packed.toDF("i", "x"), packed.toDF("j", "y")
    tasks = left.crossJoin(right).where("i <= j").repartition(max(1, blocks * (blocks + 1) // 2))
    return tasks.mapInArrow(_count_pairs, "a string, b string, common long, jaccard double, adamic_adar double")


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def side(x: pa.StructArray) -> tuple:
        """Names, degrees, and by neighbour in ascending order: the numbers of its nodes, their bounds, its degree."""
        v, dv = x.field("v"), x.field("dv")
        sizes = np.diff(v.offsets.to_numpy())
        at, key, deg = np.repeat(np.arange(len(x)), sizes), v.flatten().to_numpy(), dv.flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        return x.field("id"), x.field("deg").to_numpy(), keys, at[order], np.append(first, len(order)), deg[order][first]

    for batch in batches:
        for r in range(batch.num_rows):
            i, j = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
            (na, da, ka, xa, fa, dv), (nb, db, kb, xb, fb, _) = (side(batch.column(c)[r].values) for c in (1, 3))
            common, weight = np.zeros((len(na), len(nb)), np.int32), np.zeros((len(na), len(nb)))
            _, at_a, at_b = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            for p, q in zip(at_a.tolist(), at_b.tolist()):
                cells = np.ix_(xa[fa[p] : fa[p + 1]], xb[fb[q] : fb[q + 1]])
                common[cells] += 1
                weight[cells] += 1 / math.log(dv[p])
            if i == j:
                common = np.triu(common, 1)
            step = max(1, 200_000 // max(1, len(nb)))
            for low in range(0, len(na), step):
                x, y = np.nonzero(common[low : low + step])
                if len(x):
                    x += low
                    c = common[x, y].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([na.take(pa.array(x)), nb.take(pa.array(y)), pa.array(c), pa.array(c / (da[x] + db[y] - c)), pa.array(weight[x, y])], ["a", "b", "common", "jaccard", "adamic_adar"])


def _wedges(up: DataFrame) -> DataFrame:
    """(src, u, v): two edges of a node of which the first leads to a node that has an edge itself; without one no triangle closes."""
    inner = up.select("src", F.col("dst").alias("u")).join(up.select(F.col("src").alias("u")).distinct(), "u", "left_semi")
    return inner.join(up.select("src", F.col("dst").alias("v")), "src").where("u <> v").select("src", "u", "v")


def shared_neighbours(edges: DataFrame, least: float = 0.7, k: int = 10) -> DataFrame:
    """(id, neighbour, shared, similarity, position): for each node its neighbours by the share of their neighbours that it has too.

    The shared ones of an edge are the triangles on it. Edges are turned from lower to higher degree, so each node opens as
    many wedges as its few better connected neighbours make, hubs next to none.
    """
    both = cut(undirected(edges))
    deg = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    ranked = both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = cut(ranked.where("deg < dd or (deg = dd and src < dst)").select("src", "dst"))
    closed = _wedges(up).join(up.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"]).select("src", "u", "v")
    corners = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("src", "u"), ("src", "v"), ("u", "v"), ("u", "src"), ("v", "src"), ("v", "u"))])
    shared = closed.select(F.explode(corners).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("dd")), "dst").withColumn("similarity", F.col("shared") / F.col("dd")).where(F.col("similarity") >= least)
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return scored.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "shared", "similarity", F.row_number().over(w).alias("position")).where(F.col("position") <= k)


def _weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w): both directions of each undirected edge, weights added up; a loop counts twice, as both its ends do."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), (2 * F.col("w")).alias("w")))).otherwise(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    return one.select(F.explode(ways).alias("e")).select("e.*")


def _quality(both: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    inner = labels.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    outer = labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    flows = both.join(inner, "src").join(outer, "dst").groupBy(F.col("ls").alias("label")).agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.broadcast(both.agg(F.sum("w").alias("m2")))
    return flows.join(total).agg(F.sum(F.col("inside") / F.col("m2") - resolution * F.pow(F.col("tot") / F.col("m2"), 2)).alias("modularity"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of communities (id, label), from sums per community; edges may carry a weight."""
    return _quality(_weighted(edges), labels, resolution)


def _wishes(both: DataFrame, labels: DataFrame, m2: float, resolution: float) -> DataFrame:
    """(id, now, to, gain): where each node gains most modularity, the least label of equals; gain 0 if it stays."""
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    own = labels.join(degree, "id")
    tot = own.groupBy("label").agg(F.sum("k").alias("tot"))
    # The own community is a candidate too, with or without an edge into it.
    ties = both.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
    cand = ties.unionByName(labels.select("id", "label", F.lit(0.0).alias("w"))).groupBy("id", "label").agg(F.sum("w").alias("w"))
    cand = cand.join(own.select("id", F.col("label").alias("now"), "k"), "id").join(tot, "label")
    without = F.col("tot") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
    cand = cand.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * without / m2, 9))
    best = cand.groupBy("id").agg(F.max("now").alias("now"), F.max(F.when(F.col("label") == F.col("now"), F.col("gain"))).alias("stay"), F.max("gain").alias("best"), F.min_by("label", F.struct(-F.col("gain"), F.col("label"))).alias("to"))
    return best.select("id", "now", F.when(F.col("best") > F.col("stay"), F.col("to")).otherwise(F.col("now")).alias("to"), F.greatest(F.col("best") - F.col("stay"), F.lit(0.0)).alias("gain"))


def _apart(wishes: DataFrame) -> DataFrame:
    """The moves that are the best of both their communities: no two of them touch one community, so their gains add up."""
    moves = wishes.where("now <> to")
    pick = moves.select("id", "gain", F.explode(F.array("now", "to")).alias("c")).groupBy("c").agg(F.min_by("id", F.struct(-F.col("gain"), F.col("id"))).alias("id"))
    both = pick.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id", F.lit(True).alias("goes"))
    return wishes.join(both, "id", "left").select("id", F.when(F.col("goes"), F.col("to")).otherwise(F.col("now")).alias("label"))


def louvain(edges: DataFrame, resolution: float = 1.0, gain: float = 1e-7) -> DataFrame:
    """(id, community): local moves by modularity gain, then the same on the graph of the communities, until nothing gains.

    First the nodes of one half, by hash and in turn, move all at once. Such a round may lose; then it doesn't count, and
    from the second loss on only moves that touch different communities are made, whose gains add up: at least the best one
    each round, so it ends. A community is named by its least node. Each round is a few joins on written tables; two numbers
    of it reach the driver.
    """
    both = cut(_weighted(edges))
    m2 = both.agg(F.sum("w")).first()[0]
    names = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    if not m2:
        return names
    names = cut(names)
    while True:
        labels = cut(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
        start = score = _quality(both, labels, resolution).first()[0]
        turn = lost = 0
        while True:
            wishes = cut(_wishes(both, labels, m2, resolution))
            # Modularity rises by twice the gain over the total weight.
            if 2 * (wishes.agg(F.sum("gain")).first()[0] or 0) / m2 <= gain:
                break
            mine = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
            now = cut(wishes.select("id", F.when(mine, F.col("to")).otherwise(F.col("now")).alias("label")) if lost < 2 else _apart(wishes))
            after, turn = _quality(both, now, resolution).first()[0], turn + 1
            if after > score:
                labels, score = now, after
            elif lost < 2:
                lost += 1
            else:
                break
        if score <= start + gain:
            break
        least = labels.groupBy("label").agg(F.min("id").alias("to"))
        labels = cut(labels.join(least, "label").select("id", "to"))
        names = cut(names.join(labels.select(F.col("id").alias("community"), "to"), "community").select("id", F.col("to").alias("community")))
        a, b = labels.select(F.col("id").alias("src"), F.col("to").alias("s")), labels.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        both = cut(both.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")))
    first = names.groupBy("community").agg(F.min("id").alias("least"))
    return names.join(first, "community").select("id", F.col("least").alias("community"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density 2e / n(n - 1), average degree."""
    e = undirected(edges)
    n = e.agg(F.count_distinct("src").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    return n.withColumn("density", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1.0))).withColumn("average_degree", F.try_divide(2.0 * F.col("edges"), F.col("nodes")))


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): waves of a dependency graph src -> dst; a node comes after all it depends on; cycles, and what waits for them, come last."""
    e = edges.select("src", "dst").distinct()
    left = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    out, k = None, 0
    while True:
        blocked = e.join(left, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        ready = cut(left.join(blocked, "id", "left_anti").withColumn("level", F.lit(k)))
        if not ready.limit(1).count():
            break
        out = ready if out is None else cut(out.unionByName(ready)) if k % 20 == 0 else out.unionByName(ready)
        left = cut(left.join(ready, "id", "left_anti"))
        k += 1
    rest = left.withColumn("level", F.lit(k))
    return rest if out is None else out.unionByName(rest)


def top(ranked: DataFrame, by: str, score: str, k: int) -> DataFrame:
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id"))).where(F.col("position") <= k)


def eigenvector(edges: DataFrame, rounds: int = 30, every: int = 5) -> DataFrame:
    """(id, score): power iteration of the undirected adjacency plus identity (so bipartite graphs settle), largest score one."""
    both = cut(undirected(edges))
    scores = both.select(F.col("src").alias("id")).distinct().withColumn("score", F.lit(1.0))
    for k in range(rounds):
        got = both.join(scores, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("to")).agg(F.sum("score").alias("got"))
        d = scores.join(got, F.col("id") == F.col("to")).select("id", (F.col("score") + F.col("got")).alias("score"))
        most = d.agg(F.max("score").alias("most"))
        scores = d.join(F.broadcast(most)).select("id", (F.col("score") / F.col("most")).alias("score"))
        if k % every == every - 1:
            scores = cut(scores)
    return scores


def betweenness(edges: DataFrame, samples: int | None = None, most: int = 64) -> DataFrame:
    """(id, betweenness): share of shortest paths through each node, undirected, over (n - 1)(n - 2).

    Exact, from all nodes, unless `samples` asks for an estimate from that many nodes (those of least hash), scaled up,
    whatever the size of the graph. One join per level of a breadth-first search from all sources together, forth with path
    counts and back with dependencies; levels are written as they end. Paths over `most` edges raise an error.
    """
    both = cut(undirected(edges))
    nodes = cut(both.select(F.col("src").alias("id")).distinct())
    n = nodes.count()
    sources = nodes if samples is None else nodes.orderBy(F.xxhash64("id"), "id").limit(samples)
    k = n if samples is None else min(samples, n)
    levels = [cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths")))]
    # A neighbour of a level lies in it, in the one before, or is new.
    while True:
        reached = levels[-1].join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for done in levels[-2:]:
            reached = reached.join(done.select("source", "node"), ["source", "node"], "left_anti")
        now = cut(reached)
        if not now.limit(1).count():
            break
        if len(levels) > most:
            raise ValueError(f"paths of more than {most} edges")
        levels.append(now)
    below, parts = None, []
    for d in reversed(levels[1:]):
        got = d.withColumn("dependency", F.lit(0.0)) if below is None else d.join(below, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("dependency", F.lit(0.0)).alias("dependency"))
        got = cut(got)
        parts.append(got.select("node", "dependency"))
        before = levels[len(levels) - 1 - len(parts)]
        share = got.select("source", F.col("node").alias("child"), ((1 + F.col("dependency")) / F.col("paths")).alias("share"))
        up = share.join(both, F.col("child") == F.col("src")).select("source", F.col("dst").alias("node"), "share")
        below = up.join(before, ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("share") * F.col("paths")).alias("dependency"))
    scale = n / k / max(1, (n - 1) * (n - 2))
    total = nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("dependency"))
    for p in parts:
        total = total.unionByName(p)
    return total.groupBy(F.col("node").alias("id")).agg((F.sum("dependency") * scale).alias("betweenness"))


def blended_centrality(edges: DataFrame, samples: int | None = None) -> DataFrame:
    """(id, centrality): 0.3 of degree over n - 1, 0.3 of betweenness, 0.4 of PageRank."""
    degree = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    n = degree.agg(F.count(F.lit(1)).alias("n"))
    d = degree.join(betweenness(edges, samples), "id").join(pagerank(edges), "id").join(F.broadcast(n))
    return d.select("id", (0.3 * F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)) + 0.3 * F.col("betweenness") + 0.4 * F.col("rank")).alias("centrality"))
