"""Event queries in batch form; the streaming forms are tested for equality with these."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans import views as v
from orrery.plans.registry import query
from orrery.streaming import events as ev
from orrery.streaming import state


def _events(spark, sf):
    return v.table(spark, sf, "events")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    e = _events(spark, sf).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return ev.tumbling(e, "1 hour").select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("SELECT CAST(s AS VARCHAR) AS start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, event_type FROM events) GROUP BY 1, 2")
def sliding_windows(spark, sf):
    return ev.tumbling(_events(spark, sf), "1 hour", slide="30 minutes").select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return ev.sessions(_events(spark, sf), "2 hours").select("user_id", F.col("start").cast("string").alias("start"), "n")


@query("SELECT event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def latest_quotes(spark, sf):
    return ev.latest_per_key(_events(spark, sf)).drop("ts")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def recent_events(spark, sf):
    return ev.last_n(_events(spark, sf), 10).select("user_id", "event_id")


@query("SELECT DISTINCT CASE WHEN t = 'purchase' THEN 'ann' WHEN t = 'user:7' THEN 'bob' ELSE 'bob' END AS subscriber, event_id FROM (SELECT event_id, unnest([event_type, 'user:' || user_id]) AS t FROM events) WHERE t IN ('purchase', 'user:7', 'error')")
def topic_routing(spark, sf):
    subs = spark.createDataFrame([("ann", "purchase"), ("bob", "user:7"), ("bob", "error")], "subscriber string, topic string")
    return ev.route(_events(spark, sf), subs).select("subscriber", "event_id")


@query("SELECT event_id, least(5 * pow(2, event_id % 8), 300)::DOUBLE AS delay, CASE WHEN event_id % 8 < 3 THEN 'retry' ELSE 'dead' END AS state FROM events WHERE event_type = 'error'")
def retry_backoff(spark, sf):
    e = _events(spark, sf).where("event_type = 'error'").withColumn("attempt", F.col("event_id") % 8)
    return ev.backoff(e).select("event_id", "delay", "state")


@query("""WITH q AS (SELECT event_id, user_id % 4 AS priority, CASE WHEN event_id % 3 = 0 THEN ts END AS s, row_number() OVER (ORDER BY user_id % 4, CASE WHEN event_id % 3 = 0 THEN ts END NULLS LAST, event_id) AS k FROM events) SELECT event_id, CAST(k AS INT) AS position FROM q WHERE k <= 500 AND k < coalesce((SELECT min(k) FROM q WHERE k <= 500 AND s > TIMESTAMP '2024-01-12'), 501)""")
def priority_queue(spark, sf):
    e = _events(spark, sf).select("event_id", (F.col("user_id") % 4).alias("priority"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("scheduled_at"))
    return ev.ready(e, F.lit("2024-01-12").cast("timestamp_ntz"), 500).select("event_id", "position")


@query("""WITH l AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view') SELECT l.id, r.value AS as_of FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_join(spark, sf):
    e = _events(spark, sf)
    return ev.as_of_join(e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("id", "as_of")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_payloads(spark, sf):
    return _events(spark, sf).groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY) WHERE k <= 20")
def live_history(spark, sf):
    """What stream state with a time to live of five days and a cap of twenty events a user holds after the last watermark."""
    return state.recent(_events(spark, sf), "user_id", 5 * 86400, 20)


@query("""WITH RECURSIVE e AS (SELECT event_id, ts, user_id || '|' || event_type AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events), w AS (SELECT event_id, k, i, ts, ts AS kept FROM e WHERE i = 1
 UNION ALL SELECT e.event_id, e.k, e.i, e.ts, CASE WHEN e.ts >= w.kept + INTERVAL 1 DAY THEN e.ts ELSE w.kept END FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1) SELECT event_id FROM w WHERE ts = kept""")
def first_seen_events(spark, sf):
    """The events that repeat no user and type let through within a day."""
    return state.first_seen(_events(spark, sf), ["user_id", "event_type"], 86400).select("event_id")
