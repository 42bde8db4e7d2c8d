"""Graph queries: regions, nations, suppliers and parts as nodes, their keys as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.plans import views as v
from orrery.plans.registry import query


def edges(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda df, a, b, x, y, k: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(k).alias("kind"))
    t = lambda n: v.table(spark, sf, n)
    supplied = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    return e(t("nation"), "n", "r", "n_nationkey", "n_regionkey", "IN").unionByName(e(t("supplier"), "s", "n", "s_suppkey", "s_nationkey", "IN")).unionByName(e(supplied, "s", "p", "l_suppkey", "l_partkey", "SUPPLIES"))


EDGES = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS kind FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN' FROM supplier
 UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES' FROM lineitem), und AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges))"""


@query(f"WITH {EDGES}, d AS (SELECT src AS id, count(*) AS degree FROM und GROUP BY 1) SELECT id, degree, round(degree / (SELECT max(degree) FROM d)::DOUBLE, 6) AS centrality FROM d")
def degree_centrality(spark, sf):
    return v.rounded(graph.degree_centrality(edges(spark, sf)))


_N = 4
_PR = ""
for _k in range(_N):
    _PR += f""", p{_k + 1} AS MATERIALIZED (SELECT n.id, 0.15e0 / c.n + 0.85e0 * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM nodes n CROSS JOIN (SELECT count(*) AS n FROM nodes) c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM p{_k} WHERE id NOT IN (SELECT src FROM e)) l
 LEFT JOIN (SELECT e.dst, sum(p.rank / o.n) AS got FROM e JOIN p{_k} p ON e.src = p.id JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = e.src GROUP BY 1) g ON g.dst = n.id)"""


@query(f"""WITH {EDGES}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), nodes AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)), p0 AS (SELECT id, 1e0 / (SELECT count(*) FROM nodes) AS rank FROM nodes){_PR} SELECT id, round(rank, 9) AS rank FROM p{_N}""")
def pagerank(spark, sf):
    return v.rounded(graph.pagerank(edges(spark, sf), rounds=_N), 9)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src AS id, src AS seen FROM und UNION SELECT w.id, und.dst FROM w JOIN und ON und.src = w.seen) SELECT id, min(seen) AS component FROM w GROUP BY 1""")
def connected_components(spark, sf):
    return graph.components(edges(spark, sf))


@query(f"""WITH {EDGES}, l0 AS (SELECT DISTINCT src AS id, src AS label FROM und){''.join(f", l{k + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT u.src AS id, l.label, row_number() OVER (PARTITION BY u.src ORDER BY count(*) DESC, l.label) AS k FROM und u JOIN l{k} l ON l.id = u.dst GROUP BY u.src, l.label) WHERE k = 1)" for k in range(3))} SELECT id, label FROM l3""")
def label_propagation(spark, sf):
    return graph.label_propagation(edges(spark, sf), rounds=3)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT 'r0' AS id, 0 AS d UNION SELECT u.dst, w.d + 1 FROM w JOIN und u ON u.src = w.id WHERE w.d < 3) SELECT 'r0' AS start, id, CAST(min(d) AS INT) AS distance FROM w GROUP BY id""")
def k_hop_reach(spark, sf):
    return graph.reach(edges(spark, sf), spark.createDataFrame([("r0",)], "id string"), 3)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src AS a, dst AS b, 1 AS d FROM edges WHERE src LIKE 's%' UNION SELECT w.a, e.dst, w.d + 1 FROM w JOIN edges e ON e.src = w.b WHERE w.d < 3) SELECT a, b, CAST(min(d) AS INT) AS distance FROM w WHERE b = 'r1' GROUP BY 1, 2""")
def shortest_paths(spark, sf):
    e = edges(spark, sf)
    pairs = e.where("src like 's%'").select(F.col("src").alias("a"), F.lit("r1").alias("b")).distinct()
    return graph.shortest_paths(e, pairs, 3)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src AS a, [src, dst] AS path FROM edges WHERE src LIKE 's%' UNION ALL SELECT w.a, list_append(path, e.dst) FROM w JOIN edges e ON e.src = path[-1] WHERE len(path) < 4 AND NOT list_contains(path, e.dst)) SELECT DISTINCT a, path[-1] AS b, array_to_string(path, '>') AS path FROM w WHERE path[-1] LIKE 'r%'""")
def all_simple_paths(spark, sf):
    e = edges(spark, sf)
    pairs = e.where("src like 's%'").select(F.col("src").alias("a")).distinct().crossJoin(e.where("dst like 'r%'").select(F.col("dst").alias("b")).distinct())
    return graph.all_paths(e, pairs, 3).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {EDGES} SELECT src AS id, dst AS neighbour, 'out' AS direction FROM edges WHERE src LIKE 'n%' UNION ALL SELECT dst, src, 'in' FROM edges WHERE dst LIKE 'n%'")
def typed_neighbours(spark, sf):
    nodes = v.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.neighbours(edges(spark, sf), nodes)


# Nations and the months their customers order in, weighted by the number of orders.
def _weights(spark, sf):
    o = v.table(spark, sf, "orders").join(v.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


_BUSY = EDGES.replace("UNION ALL SELECT DISTINCT 's'", "UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'm' || strftime(o_orderdate, '%Y-%m'), 'ORDERS' FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT DISTINCT 's'")


@query(f"""WITH {_BUSY}, d AS (SELECT src, count(*) AS n FROM und GROUP BY 1), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common, sum(1 / ln(d.n)) AS aa FROM und x JOIN und y ON x.dst = y.dst AND x.src < y.src JOIN d ON d.src = x.dst GROUP BY 1, 2)
SELECT a, b, common, round(common / (da.n + db.n - common)::DOUBLE, 6) AS jaccard, round(aa, 6) AS adamic_adar FROM c JOIN d da ON da.src = a JOIN d db ON db.src = b""")
def node_similarity(spark, sf):
    busy = _weights(spark, sf).select("src", "dst", F.lit("ORDERS").alias("kind"))
    return v.rounded(graph.common_neighbours(edges(spark, sf).unionByName(busy)))


_TRI = EDGES.replace("UNION ALL SELECT DISTINCT 's'", "UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 'NEAR' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT DISTINCT 's'")


@query(f"""WITH {_TRI}, d AS (SELECT src, count(*) AS n FROM und GROUP BY 1), t AS (SELECT e.src AS id, e.dst AS neighbour, count(*) AS shared FROM und e JOIN und x ON x.src = e.src JOIN und y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2),
r AS (SELECT id, neighbour, shared, shared / d.n::DOUBLE AS similarity, row_number() OVER (PARTITION BY id ORDER BY shared / d.n::DOUBLE DESC, neighbour) AS position FROM t JOIN d ON d.src = neighbour WHERE shared / d.n::DOUBLE >= 0.7) SELECT id, neighbour, shared, round(similarity, 6) AS similarity, CAST(position AS INT) AS position FROM r WHERE position <= 10""")
def shared_neighbours(spark, sf):
    near = v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    near = near.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("NEAR").alias("kind"))
    return v.rounded(graph.shared_neighbours(edges(spark, sf).unionByName(near)))


# Rounds of moves are beyond SQL; tests hold it against label propagation and all partitions of small graphs.
@query()
def louvain_communities(spark, sf):
    return graph.louvain(_weights(spark, sf))


@query("""WITH w AS (SELECT 'n' || c_nationkey AS src, 'm' || strftime(o_orderdate, '%Y-%m') AS dst, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w), l AS (SELECT DISTINCT src AS id, CASE WHEN src LIKE 'n%' THEN CAST(substr(src, 2) AS INT) % 5 ELSE CAST(substr(src, 7) AS INT) % 5 END AS label FROM b),
c AS (SELECT x.label, sum(w) AS tot, sum(w) FILTER (x.label = y.label) AS inside FROM b JOIN l x ON x.id = src JOIN l y ON y.id = dst GROUP BY 1), m AS (SELECT sum(w) AS m2 FROM b) SELECT round(sum(coalesce(inside, 0) / m2::DOUBLE - pow(tot / m2::DOUBLE, 2)), 9) AS modularity FROM c, m""")
def partition_modularity(spark, sf):
    w = _weights(spark, sf)
    ids = w.select(F.col("src").alias("id")).union(w.select("dst")).distinct()
    number = F.when(F.col("id").startswith("n"), F.substring("id", 2, 9)).otherwise(F.substring("id", 7, 9)).cast("int")
    return v.rounded(graph.modularity(w, ids.withColumn("label", number % 5)), 9)


@query(f"WITH {EDGES}, s AS (SELECT count(DISTINCT src) AS n, CAST(count(*) / 2 AS BIGINT) AS e FROM und) SELECT n AS nodes, e AS edges, round(2.0 * e / (n * (n - 1.0)), 9) AS density, round(2.0 * e / n, 9) AS average_degree FROM s")
def graph_statistics(spark, sf):
    return v.rounded(graph.statistics(edges(spark, sf)), 9)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src AS id, 0 AS level FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, w.level + 1 FROM w JOIN edges e ON e.src = w.id) SELECT id, CAST(max(level) AS INT) AS level FROM w GROUP BY 1""")
def dependency_levels(spark, sf):
    return graph.levels(edges(spark, sf))


@query(f"WITH {EDGES}, d AS (SELECT src AS id, substr(src, 1, 1) AS kind, count(*) AS degree FROM und GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS position FROM d) SELECT id, kind, degree, CAST(position AS INT) AS position FROM r WHERE position <= 5")
def influential_nodes(spark, sf):
    d = graph.degree_centrality(edges(spark, sf)).drop("centrality").withColumn("kind", F.substring("id", 1, 1))
    return graph.top(d, "kind", "degree", 5)
