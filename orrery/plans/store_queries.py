"""Storage queries: orders as records, events as calls and caches, documents as memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import store
from orrery.plans import views as v
from orrery.plans.registry import query


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def filtered_page(spark, sf):
    d = store.find(v.table(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 20, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None)
    return d.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-02-01'")
def interval_overlap(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = v.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    d = store.overlapping(d, "o_orderdate", "l_shipdate", F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-02-01").cast("timestamp_ntz"))
    return d.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("string").alias("shipped"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, sf):
    return store.latest(v.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT count(*) AS n_new, sum(user_id)::BIGINT AS ids FROM (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'))")
def get_or_create(spark, sf):
    e = v.table(spark, sf, "events")
    new = store.new_rows(e.where("ts >= timestamp_ntz'2024-01-15'").select("user_id").distinct(), e.where("ts < timestamp_ntz'2024-01-02'"), ["user_id"])
    return new.agg(F.count(F.lit(1)).alias("n_new"), F.sum("user_id").alias("ids"))


@query("""WITH a AS (SELECT user_id, md5(CAST(max(event_id) AS VARCHAR)) AS h FROM events GROUP BY 1), b AS (SELECT user_id, md5(CAST(max(event_id) AS VARCHAR)) AS h FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1)
SELECT a.user_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS status FROM a LEFT JOIN b USING (user_id)""")
def incremental_changes(spark, sf):
    e = v.table(spark, sf, "events")
    state = lambda d: d.groupBy("user_id").agg(F.md5(F.max("event_id").cast("string").cast("binary")).alias("h"))
    return store.changes(state(e), state(e.where("ts < timestamp_ntz'2024-01-25'")), "user_id", "h")


@query("""WITH s AS (SELECT user_id, event_id, event_type, coalesce(CAST(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type AS INT), 1) AS s FROM events) SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM s""")
def content_versions(spark, sf):
    return store.versions(v.table(spark, sf, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "version")


@query("""WITH u AS (SELECT event_type, event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) SELECT event_type, event_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 5000""")
def lru_eviction(spark, sf):
    d = v.table(spark, sf, "events").withColumn("size", F.floor("value"))
    return store.evict(d, "event_type", "size", "ts", 5000, "event_id").select("event_type", "event_id", "used")


@query("SELECT doc_id, score::INT AS score FROM (SELECT doc_id, len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')), ['the', 'and', 'der', 'les', 'license', 'token'])) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100")
def keyword_search(spark, sf):
    return store.keyword_search(v.table(spark, sf, "documents"), "text", "the and der les license token the", "doc_id", 100).select("doc_id", "score")


_MEM = "SELECT doc_id AS id, lang AS scope, CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS importance, CAST(DATE '2024-01-01' - CAST(doc_id % 700 AS INT) AS DATE) AS created_at, CASE WHEN doc_id % 9 = 0 THEN DATE '2023-12-01' END AS expires_at, doc_id % 4 AS access_count FROM documents"


@query(f"""WITH m AS ({_MEM}), r AS (SELECT *, CASE importance WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM m WHERE expires_at IS NULL OR expires_at > DATE '2024-01-01'),
k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY rank DESC, created_at DESC, id) AS k FROM r WHERE NOT (rank <= 2 AND DATE '2024-01-01' - created_at > 365 AND access_count < 2)) SELECT id, scope, importance FROM k WHERE k <= 100""")
def memory_retention(spark, sf):
    d = v.table(spark, sf, "documents")
    importance = F.expr("case doc_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end")
    m = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("scope"), importance.alias("importance"), F.expr("date_sub(date'2024-01-01', cast(doc_id % 700 as int))").alias("created_at"), F.expr("case when doc_id % 9 = 0 then date'2023-12-01' end").alias("expires_at"), (F.col("doc_id") % 4).alias("access_count"))
    return store.retained(m, F.lit("2024-01-01").cast("date"), 365, 2, 100).select("id", "scope", "importance")


@query("""SELECT day, src AS source_rank, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY src) AS k FROM (
 SELECT CAST(ts AS DATE)::VARCHAR AS day, 0 AS src, count(*) AS n FROM events WHERE event_type = 'purchase' AND day(ts) % 3 = 0 GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE)::VARCHAR, 1, count(*) FROM events WHERE event_type = 'view' AND day(ts) % 2 = 0 GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE)::VARCHAR, 2, count(*) FROM events GROUP BY 1)) WHERE k = 1""")
def source_fallback(spark, sf):
    e = v.table(spark, sf, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    count = lambda d: d.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return store.first_available([count(e.where("event_type = 'purchase' and day(ts) % 3 = 0")), count(e.where("event_type = 'view' and day(ts) % 2 = 0")), count(e)], "day")


@query("""SELECT coalesce(tool, '-') AS tool, coalesce(category, '-') AS category, count(*) AS n, round(avg(CAST(value < 100 AS DOUBLE)), 6) AS success, round(avg(value), 6) AS mean_duration, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS cost FROM (SELECT event_type AS tool, 'c' || (user_id % 3) AS category, value FROM events) GROUP BY GROUPING SETS ((tool), (category), ())""")
def usage_rollup(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("tool"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("category"), (F.col("value") < 100).alias("ok"), F.col("value").alias("duration"), F.col("value").cast("decimal(18,2)").alias("cost"))
    d = store.usage(e)
    return v.rounded(d.select(F.coalesce("tool", F.lit("-")).alias("tool"), F.coalesce("category", F.lit("-")).alias("category"), "n", "success", "mean_duration", F.col("cost").cast("double").alias("cost")))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(median(value), 6) AS median, max(value) FILTER (i = n * 95 // 100) AS p95, max(value) FILTER (i = n * 99 // 100) AS p99 FROM r GROUP BY 1""")
def latency_percentiles(spark, sf):
    return v.rounded(store.latency(v.table(spark, sf, "events"), "event_type", "value"))


@query("""WITH m AS (SELECT source, [lang, 'q' || (doc_id % 3)] AS tags, (doc_id % 10) / 10e0 AS confidence, doc_id % 50 <> 7 AS verified FROM documents) SELECT source, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, round(avg(confidence), 6) AS confidence, bool_and(verified) AS verified, count(*) AS n FROM m GROUP BY 1""")
def memory_consolidation(spark, sf):
    m = v.table(spark, sf, "documents").select("source", F.array("lang", F.concat(F.lit("q"), (F.col("doc_id") % 3).cast("string"))).alias("tags"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), (F.col("doc_id") % 50 != 7).alias("verified"))
    return v.rounded(store.consolidate(m, "source").withColumn("tags", F.array_join("tags", ",")))


@query("""WITH y AS (SELECT p_brand, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), g AS (SELECT *, (x - lag(x) OVER (PARTITION BY p_brand ORDER BY y)) / abs(lag(x) OVER (PARTITION BY p_brand ORDER BY y)) AS g FROM y)
SELECT p_brand, count(*) AS n, round(regr_slope(x, y), 2) AS slope, round(regr_r2(x, y), 6) AS r2, round(avg(g), 6) AS mean_growth, round(median(g), 6) AS median_growth, round(pow(arg_max(x, y) / arg_min(x, y), 1e0 / (count(*) - 1)) - 1, 6) AS cagr, round(arg_max(x, y) / avg(x), 6) AS to_mean FROM g GROUP BY 1""")
def metric_trends(spark, sf):
    part = v.table(spark, sf, "part").select("p_partkey", "p_brand")
    y = v.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", F.year("l_shipdate").cast("long").alias("y")).agg(v.total("l_extendedprice").alias("x"))
    d = store.trend(y, "p_brand", "y", "x").drop("first", "last", "mean").withColumn("slope", F.round("slope", 2))
    return v.rounded(d)
