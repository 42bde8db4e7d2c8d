"""Vector and retrieval queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import retrieval as r
from orrery.plans import views as v
from orrery.plans.registry import query


def _store(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _hits(spark, sf, k=10):
    s = _store(spark, sf)
    return r.search(s, s.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), k)


_COS = """s AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT q.id AS query_id, s.id, s.label, list_dot_product(q.v, s.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(s.v, s.v))) AS score FROM s JOIN s q ON q.id % 100 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c)"""


@query(f"WITH {_COS} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM h WHERE rank <= 10")
def cosine_topk(spark, sf):
    return v.rounded(_hits(spark, sf))


@query(f"WITH {_COS}, f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE label = 3 AND score >= 0) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM f WHERE rank <= 5")
def filtered_search(spark, sf):
    s = _store(spark, sf)
    return v.rounded(r.search(s.where("label = 3"), s.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5, 0.0))


@query(f"""WITH {_COS}, x AS (SELECT *, greatest(1 - (id % 60) / 30e0, 0.1e0) AS recency, (id % 7) / 7e0 AS importance FROM h WHERE rank <= 20), y AS (SELECT *, round(0.5e0 * score + 0.2e0 * recency + 0.3e0 * importance, 9) AS relevance FROM x)
SELECT query_id, id, round(relevance, 6) AS relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INT) AS rank FROM y""")
def reranked_hits(spark, sf):
    h = _hits(spark, sf, 20).withColumn("recency", F.greatest(1 - (F.col("id") % 60) / 30.0, F.lit(0.1))).withColumn("importance", (F.col("id") % 7) / 7.0)
    return v.rounded(r.rerank(h, {"score": 0.5, "recency": 0.2, "importance": 0.3}).select("query_id", "id", "relevance", "rank"))


@query("""WITH s AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.label, (SELECT count(*) FROM s t WHERE t.label = a.label) AS n, round(avg(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 6) AS coherence FROM s a JOIN s b ON a.label = b.label AND a.id < b.id GROUP BY 1""")
def evidence_coherence(spark, sf):
    return v.rounded(r.coherence(_store(spark, sf), "label"))


@query(f"""WITH {_COS}, t AS (SELECT *, 40 + id % 90 AS tokens FROM h WHERE rank <= 20), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM t) SELECT query_id, id, CAST(rank AS INT) AS rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 500 AND rank <= 8""")
def token_budget(spark, sf):
    h = _hits(spark, sf, 20).withColumn("tokens", 40 + F.col("id") % 90)
    return r.token_budget(h, 500, 8).select("query_id", "id", "rank", "used")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 412)) AS char_start FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS INT) AS chunk_index, CAST(char_start AS INT) AS char_start, sha256(substr(text, char_start + 1, 512)) AS chunk_sha256 FROM s""")
def text_chunks(spark, sf):
    return r.chunk(v.table(spark, sf, "documents")).select("doc_id", "chunk_index", "char_start", F.sha2("chunk", 256).alias("chunk_sha256"))


@query()
def diverse_context(spark, sf):
    labels = _store(spark, sf).select("id", F.col("label").cast("string").alias("kind"), (F.col("id") % 5).cast("string").alias("source"))
    return r.diverse(_hits(spark, sf, 20).join(labels, "id"), 8)
