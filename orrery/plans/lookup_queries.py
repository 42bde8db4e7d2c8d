"""Lookup queries: parts as tagged records, events as jobs and mentions, orders as records with dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import lookup
from orrery.plans import views as v
from orrery.plans.registry import query


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'small')")
def tag_lookup(spark, sf):
    d = v.table(spark, sf, "part").withColumn("tags", F.split("p_name", " "))
    return lookup.tagged(d, "tags", "small").select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3, 5, 8) AND list_contains(string_split(p_name, ' '), 'ring')")
def json_tags(spark, sf):
    d = v.table(spark, sf, "part").withColumn("tags", F.to_json(F.split("p_name", " ")))
    return lookup.json_tagged(d, "tags", ["ring"], {"p_size": [1, 2, 3, 5, 8]}).select("p_partkey")


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def range_page(spark, sf):
    d = v.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-12-31"))
    return lookup.range_page(d, "o_orderdate", low, high, [F.desc("o_orderdate"), F.asc("o_orderkey")], 100).select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20'")
def trailing_period(spark, sf):
    return lookup.trailing(v.table(spark, sf, "events"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 7).select("event_id")


@query("""SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small ring' THEN 3 WHEN starts_with(lower(p_name), 'small ring') THEN 2 WHEN contains(lower(p_name), 'small ring') THEN 1 END AS rank FROM part) WHERE rank IS NOT NULL ORDER BY rank DESC, p_name || chr(0) || lpad(CAST(p_partkey AS VARCHAR), 12, '0') LIMIT 20""")
def name_search(spark, sf):
    d = v.table(spark, sf, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit("\0"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("sortable"))
    ranked = lookup.name_search(d.withColumnRenamed("p_name", "shown").withColumn("p_name", F.col("shown")), "p_name", "Small Ring", 1 << 30)
    return ranked.orderBy(F.desc("rank"), "sortable").limit(20).select("p_partkey", "p_name", "rank")


@query("SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1, 2")
def known_edges(spark, sf):
    edges = v.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_orderkey", "l_partkey")
    o = v.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    p = v.table(spark, sf, "part").where("p_size <= 10").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return lookup.known_edges(edges, o.unionByName(p)).groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT user_id, event_id AS id, epoch_us(ts) // 1000000 AS at, event_type AS kind FROM events)
SELECT a.user_id, a.id AS first, b.id AS second, b.at - a.at AS distance FROM m a JOIN m b ON a.user_id = b.user_id AND b.at - a.at BETWEEN 0 AND 3600 AND (b.at > a.at OR b.id > a.id) AND a.kind <> b.kind""")
def near_mentions(spark, sf):
    m = v.table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("at"), F.col("event_type").alias("kind"))
    return lookup.near_pairs(m, "user_id", "at", "kind", 3600)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) ON o_custkey = c_custkey AND k = 1")
def first_match(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return lookup.first_match(v.table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query(f"""WITH {v.POSITIONS}, w AS (SELECT portfolio, symbol, sum(market_value) / sum(sum(market_value)) OVER (PARTITION BY portfolio) AS weight FROM positions GROUP BY 1, 2),
b AS (SELECT symbol, CAST(substr(symbol, 7) AS INT) AS k FROM (SELECT DISTINCT symbol FROM positions))
SELECT portfolio, f.factor, round(sum(weight * CASE f.factor WHEN 'market' THEN 0.5e0 + k / 50e0 ELSE (k % 7) / 10e0 END), 6) AS exposure FROM w JOIN b USING (symbol), (VALUES ('market'), ('size')) f(factor) GROUP BY 1, 2""")
def factor_exposure(spark, sf):
    p = v.positions(spark, sf).groupBy("portfolio", "symbol").agg(F.sum("market_value").alias("mv"))
    total = p.groupBy("portfolio").agg(F.sum("mv").alias("total"))
    weights = p.join(total, "portfolio").select("portfolio", "symbol", (F.col("mv") / F.col("total")).alias("weight"))
    k = F.substring("symbol", 7, 9).cast("int")
    betas = p.select("symbol").distinct().select("symbol", F.create_map(F.lit("market"), 0.5 + k / 50.0, F.lit("size"), (k % 7) / 10.0).alias("betas"))
    return v.rounded(lookup.factor_exposure(weights, betas, "portfolio"))


@query(f"WITH {v.POSITIONS} SELECT portfolio, round(sum(market_value) + 1000, 2) AS total_value, round(sum(quantity) * 900, 2) AS total_cost, round(sum(market_value) - sum(quantity) * 900, 2) AS total_pnl FROM positions GROUP BY 1")
def portfolio_totals(spark, sf):
    p = v.positions(spark, sf).withColumn("cost", F.col("quantity") * 900)
    return v.rounded(lookup.portfolio_totals(p, "portfolio", 1000.0), 2)


@query("SELECT event_type, props, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_day, CAST(max(ts) AS VARCHAR) AS last_day, round(avg(value), 6) AS confidence FROM events GROUP BY 1, 2 HAVING count(*) >= 15")
def recurring_patterns(spark, sf):
    d = lookup.recurring(v.table(spark, sf, "events"), ["event_type", "props"], "ts", "value", 15)
    return v.rounded(d.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")}))


STATE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'done' END"


@query(f"""WITH j AS (SELECT {STATE} AS state, ts, value FROM events)
SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, round(avg(value), 6) AS mean_seconds,
 round(count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 3600 SECOND AND ts <= TIMESTAMP '2024-01-20') / 3600e0, 6) AS per_second,
 round((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(min(ts) FILTER (state = 'pending'))) / 1e6, 6) AS oldest_age FROM j""")
def queue_gauges(spark, sf):
    j = v.table(spark, sf, "events").select(F.expr(STATE).alias("state"), F.col("ts").alias("created"), F.col("ts").alias("finished"), F.col("value").alias("seconds"))
    return v.rounded(lookup.queue_gauges(j, F.lit("2024-01-20").cast("timestamp_ntz"), 3600))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def ordered_counts(spark, sf):
    return lookup.ordered_counts(v.table(spark, sf, "part"), "p_brand")


@query("""SELECT 'order' AS kind, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey AS id FROM orders UNION ALL
SELECT 'shipment', CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_orderkey * 10 + l_linenumber FROM lineitem""")
def timeline(spark, sf):
    o, li = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem")
    a = o.select(F.lit("order").alias("kind"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderkey").alias("id"))
    b = li.select(F.lit("shipment").alias("kind"), F.to_date("l_shipdate").cast("string").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return lookup.timeline(a, b)


@query(f"WITH {v.POSITIONS}, s AS (SELECT portfolio, sum(market_value) AS mv FROM positions GROUP BY 1) SELECT portfolio, round(-0.3e0 + k * 0.06e0, 6) AS shock, round(mv * (-0.3e0 + k * 0.06e0) * 1.2e0, 2) AS loss FROM s, range(0, 11) r(k)")
def sensitivity_sweep(spark, sf):
    p = v.positions(spark, sf).groupBy("portfolio").agg(F.sum("market_value").alias("mv"))
    return p.select("portfolio", "mv", lookup.sweep(-0.3, 0.3, 11).alias("shock")).select("portfolio", F.round("shock", 6).alias("shock"), F.round(F.col("mv") * F.col("shock") * 1.2, 2).alias("loss"))


@query(f"""WITH {v.POSITIONS}, f AS (SELECT portfolio, sector, sum(market_value) AS mv FROM positions GROUP BY 1, 2), s AS (SELECT *, (length(sector) - 7) / 10e0 AS shock, sum(mv) OVER (PARTITION BY portfolio) * 0.1e0 AS loss FROM f)
SELECT portfolio, sector, round(loss * abs(shock) / sum(abs(shock)) OVER (PARTITION BY portfolio), 2) AS contribution FROM s""")
def shock_attribution(spark, sf):
    f = v.positions(spark, sf).groupBy("portfolio", "sector").agg(F.sum("market_value").alias("mv"))
    total = f.groupBy("portfolio").agg((F.sum("mv") * 0.1).alias("loss"))
    d = f.join(total, "portfolio").withColumn("shock", (F.length("sector") - 7) / 10.0)
    return lookup.shock_shares(d, "portfolio", "loss").select("portfolio", "sector", F.round("contribution", 2).alias("contribution"))


@query("SELECT event_type AS state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def regime_frequency(spark, sf):
    paths = v.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list("event_type").alias("states"))
    return v.rounded(lookup.state_frequency(paths, "states"))


LINKS = "SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


@query(f"WITH RECURSIVE l AS ({LINKS}), t AS (SELECT child, parent AS ancestor, 1 AS depth FROM l UNION ALL SELECT t.child, l.parent, depth + 1 FROM t JOIN l ON l.child = t.ancestor) SELECT * FROM t")
def company_hierarchy(spark, sf):
    s, n = v.table(spark, sf, "supplier"), v.table(spark, sf, "nation")
    links = s.select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    return lookup.hierarchy(links)


ALIASES = [("small ring", "Ring Works"), ("small", "Small Goods"), ("ring", "Rings"), ("bolt", "Bolts")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name), '{a}') THEN '{n}'" for a, n in ALIASES) + " END AS company FROM part")
def alias_lookup(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", lookup.alias_of(F.col("p_name"), ALIASES).alias("company"))


@query("""WITH c AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'acknowledged' WHEN 'purchase' THEN 'resolved' END AS state FROM events WHERE event_type IN ('view', 'click', 'purchase'))
SELECT user_id, CASE max(CASE state WHEN 'active' THEN 0 WHEN 'acknowledged' THEN 1 ELSE 2 END) WHEN 0 THEN 'active' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS state,
 CAST(min(ts) FILTER (state = 'acknowledged') AS VARCHAR) AS acknowledged_at, CAST(min(ts) FILTER (state = 'resolved') AS VARCHAR) AS resolved_at FROM c GROUP BY 1""")
def alert_lifecycle(spark, sf):
    state = F.expr("CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'acknowledged' WHEN 'purchase' THEN 'resolved' END")
    d = lookup.latest_state(v.table(spark, sf, "events").select("user_id", "ts", state.alias("state")), "user_id", "ts", {"active": 0, "acknowledged": 1, "resolved": 2})
    return d.select("user_id", "state", F.col("acknowledged_at").cast("string").alias("acknowledged_at"), F.col("resolved_at").cast("string").alias("resolved_at"))


@query("SELECT event_id AS schedule_id FROM events WHERE value > 5 AND ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id")
def due_schedules(spark, sf):
    s = v.table(spark, sf, "events").select(F.col("event_id").alias("schedule_id"), (F.col("value") > 5).alias("enabled"), (F.col("ts") + F.expr("interval 1 day")).alias("next_run"))
    return lookup.due(s, F.lit("2024-01-10").cast("timestamp_ntz")).select("schedule_id")


@query(f"""WITH {v.POSITIONS}, p AS (SELECT symbol AS asset, sum(market_value) AS mv, CAST(substr(symbol, 7) AS INT) AS k FROM positions GROUP BY 1), a AS (SELECT asset, mv / sum(mv) OVER () AS weight, k FROM p),
x AS (SELECT asset, weight, factor, CASE factor WHEN 'market' THEN 0.5e0 + k / 50e0 ELSE (k % 7) / 10e0 END AS beta FROM a, (VALUES ('market'), ('size')) f(factor)),
c AS (SELECT * FROM (VALUES ('market', 'market', 0.04e0), ('market', 'size', 0.01e0), ('size', 'market', 0.01e0), ('size', 'size', 0.02e0)) c(f, g, cov)),
s AS (SELECT i.asset, any_value(i.weight) AS weight, sum(i.beta * cov * j.beta * j.weight) + any_value(i.weight) * 0.03e0 AS s FROM x i JOIN c ON c.f = i.factor JOIN x j ON j.factor = c.g GROUP BY 1),
g AS (SELECT sqrt(sum(weight * s)) AS sigma FROM s)
SELECT asset, round(s / sigma, 6) AS mcr, round(weight * s / sigma, 6) AS ccr, round(1.645e0 * weight * s / sigma, 6) AS var FROM s, g""")
def factor_risk(spark, sf):
    p = v.positions(spark, sf).groupBy(F.col("symbol").alias("asset")).agg(F.sum("market_value").alias("mv"))
    total = p.agg(F.sum("mv").alias("total"))
    k = F.substring("asset", 7, 9).cast("int")
    w = p.join(F.broadcast(total)).select("asset", (F.col("mv") / F.col("total")).alias("weight"), F.explode(F.create_map(F.lit("market"), 0.5 + k / 50.0, F.lit("size"), (k % 7) / 10.0)).alias("factor", "beta"))
    cov = spark.createDataFrame([("market", "market", 0.04), ("market", "size", 0.01), ("size", "market", 0.01), ("size", "size", 0.02)], "f string, g string, cov double")
    return v.rounded(lookup.factor_risk(w, cov, p.select("asset", F.lit(0.03).alias("d")), 1.645))
