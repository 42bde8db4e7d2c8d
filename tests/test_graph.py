"""Communities, similarity and levels against brute force on small graphs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, lookup
from orrery.plans import graphs_queries, registry


def frame(spark, edges, weight=False):
    return spark.createDataFrame(edges, "src string, dst string" + (", weight double" if weight else ""))


def _modularity(edges, label):
    m2 = 2 * sum(w for *_, w in edges)
    inside, tot = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            tot[label[x]] = tot.get(label[x], 0) + w
            inside[label[x]] = inside.get(label[x], 0) + (w if label[x] == label[y] else 0)
    return sum(inside[c] / m2 - (tot[c] / m2) ** 2 for c in tot)


def _partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in _partitions(nodes[1:]):
        for k in range(len(rest)):
            yield rest[:k] + [[nodes[0], *rest[k]]] + rest[k + 1 :]
        yield [[nodes[0]], *rest]


def test_louvain_finds_the_best_partition_of_two_triangles_and_a_bridge(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)]
    best = max(_modularity(edges, {v: k for k, p in enumerate(parts) for v in p}) for parts in _partitions(list("abcdef")))
    got = {r.id: r.community for r in graph.louvain(frame(spark, edges, True)).collect()}
    assert _modularity(edges, got) == pytest.approx(best) and got["a"] == got["c"] == "a" and got["d"] == got["f"] == "d"
    labels = spark.createDataFrame(list(got.items()), "id string, label string")
    assert graph.modularity(frame(spark, edges, True), labels).first()[0] == pytest.approx(best)


def test_louvain_is_no_worse_than_label_propagation(spark):
    rnd = random.Random(7)
    edges = [(f"v{i}", f"v{j}", 1.0 + (i + j) % 3) for i, j in itertools.combinations(range(40), 2) if rnd.random() < (0.5 if i // 10 == j // 10 else 0.05)]
    df = frame(spark, edges, True)
    got = {r.id: r.community for r in graph.louvain(df).collect()}
    other = {r.id: r.label for r in graph.label_propagation(df, 5).collect()}
    planted = {f"v{i}": i // 10 for i in range(40)}
    assert _modularity(edges, got) >= max(_modularity(edges, other), 0.95 * _modularity(edges, planted)) - 1e-9


def test_louvain_without_edges_and_with_loops(spark):
    assert graph.louvain(frame(spark, [])).collect() == []
    got = {r.id: r.community for r in graph.louvain(frame(spark, [("a", "a"), ("b", "c")])).collect()}
    assert got == {"a": "a", "b": "b", "c": "b"}


def test_similarity_equals_all_pairs(spark):
    rnd = random.Random(3)
    edges = [(f"x{i}", f"y{j}") for i in range(30) for j in range(12) if rnd.random() < 0.4] + [("hub", f"x{i}") for i in range(30)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for least in (0.3, 0.7):
        want = {}
        for a, b in itertools.permutations(near, 2):
            c = near[a] & near[b]
            j = len(c) / len(near[a] | near[b])
            if c and j >= least:
                want.setdefault(a, []).append((-round(j, 9), b, round(sum(1 / math.log(len(near[v])) for v in c if len(near[v]) > 1), 6)))
        got = {}
        for r in graph.similarity(frame(spark, edges), least, 5).orderBy("a", "position").collect():
            got.setdefault(r.a, []).append((-round(r.jaccard, 9), r.b, round(r.adamic_adar, 6)))
        assert got == {a: sorted(v)[:5] for a, v in want.items()}


def test_node_similarity_has_all_pairs_with_a_common_neighbour(spark):
    queries, sf = registry.QUERIES, "/root/testdata/sf0.001"
    got = {(r.a, r.b): r for r in queries["node_similarity"](spark, sf).where("a like 'n%' or b like 's%'").collect()}
    near = {}
    e = graphs_queries.edges(spark, sf).select("src", "dst").union(graphs_queries._weights(spark, sf).select("src", "dst"))
    for a, b in e.distinct().collect():
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {(a, b): near[a] & near[b] for a, b in itertools.combinations(sorted(near), 2) if near[a] & near[b] and (a[0] == "n" or b[0] == "s")}
    assert got.keys() == want.keys()
    for (a, b), c in want.items():
        assert (got[a, b].common, got[a, b].jaccard) == (len(c), pytest.approx(len(c) / len(near[a] | near[b]), abs=1e-6))
        assert got[a, b].adamic_adar == pytest.approx(sum(1 / math.log(len(near[v])) for v in c), abs=1e-6)
    assert min(r.jaccard for r in got.values()) < 0.4 and max(sum(x == a for x, _ in got) for a in near) > 10


def test_shared_neighbours_equal_set_overlaps(spark):
    rnd = random.Random(4)
    edges = [(f"v{i}", f"v{j}") for i, j in itertools.combinations(range(14), 2) if rnd.random() < 0.6]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {(a, b): len(near[a] & near[b]) / len(near[b]) for a in near for b in near[a] if len(near[a] & near[b]) / len(near[b]) >= 0.5}
    got = {(r.id, r.neighbour): r.similarity for r in graph.shared_neighbours(frame(spark, edges), 0.5, 20).collect()}
    assert got == pytest.approx(want) and want


def test_long_chains_have_no_last_level(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(52)]
    got = {r.id: r.level for r in graph.levels(frame(spark, chain)).collect()}
    assert got == {f"{i:03d}": i for i in range(53)}


def test_hierarchies_deeper_than_twenty_levels(spark):
    links = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(24)], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in lookup.hierarchy(links).collect()}
    assert got == {(f"{i:02d}", f"{j:02d}"): j - i for i in range(25) for j in range(i + 1, 25)}


def test_pairs_of_blocks_equal_all_pairs_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIR_BLOCK", 7, raising=False)
    rnd = random.Random(8)
    rows = [(f"n{rnd.randrange(30)}", f"é{rnd.randrange(12)}") for _ in range(90)] + [("n1", "n2"), ("n2", "n1"), ("n3", "n3")]
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {}
    for a in near:
        for b in near:
            c = near[a] & near[b]
            if a.encode() < b.encode() and c:
                want[a, b] = (len(c), round(len(c) / len(near[a] | near[b]), 9), round(sum(1 / math.log(len(near[v])) for v in c), 9))
    out = graph.common_neighbours(spark.createDataFrame(rows, "src string, dst string"))
    got = out.collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.common, round(r.jaccard, 9), round(r.adamic_adar, 9)) for r in got} == want
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_edges_to_hubs_open_no_wedges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(df.cache()) or seen[-1])
    rows = [(f"p{i}", f"s{j}") for i in range(20) for j in range(9)] + [("s0", "n0"), ("n0", "r0"), ("s0", "r0")]
    got = graph.shared_neighbours(spark.createDataFrame(rows, "src string, dst string"), 0.0).collect()
    assert {(r.id, r.neighbour, r.shared) for r in got} == {(a, b, 1) for a in ("s0", "n0", "r0") for b in ("s0", "n0", "r0") if a != b}
    # Parts lead to suppliers, which lead nowhere: of 20 * 9 * 8 + 2 pairs of edges those of the triangle are left.
    assert graph._wedges(seen[-1]).count() == 1
