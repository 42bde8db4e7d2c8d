"""Outlook and recognition queries: segments as portfolios, brands as tickers, suppliers as companies, events as signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import graph, outlook, recognition, risk
from orrery.plans import views as v
from orrery.plans.graphs_queries import EDGES, edges
from orrery.plans.registry import query

_S = [", ".join(f"{outlook.score_sql(t, base, r)} AS s{i}_{r}" for r in outlook.REGIMES) for i, (t, base, _) in enumerate(outlook.SCORERS)]
_T = [" + ".join(f"s{i}_{r}" for r in outlook.REGIMES) for i in range(3)]
_B = ", ".join(f"{' + '.join(f'CAST({w!r} AS DOUBLE) * coalesce(s{i}_{r} / nullif(t{i}, 0), 0)' for i, (_, _, w) in enumerate(outlook.SCORERS))} AS b_{r}" for r in outlook.REGIMES)
_ALL = " + ".join(f"b_{r}" for r in outlook.REGIMES)


@query(f"""WITH {v.RETURNS}, w AS (SELECT *, avg(r) OVER (o ROWS 5 PRECEDING) AS trend, value / lag(value, 3) OVER o - 1 AS momentum,
stddev_pop(r) OVER (o ROWS 5 PRECEDING) / nullif(stddev_pop(r) OVER (o ROWS UNBOUNDED PRECEDING), 0) AS volatility FROM returns WINDOW o AS (PARTITION BY portfolio ORDER BY day)),
f AS (SELECT portfolio, day, round(trend, 9) AS trend, round(momentum, 9) AS momentum, round(volatility, 9) AS volatility, 0e0 AS breadth, 0.3e0 AS correlation, 0e0 AS yield_curve, 0e0 AS credit, 0e0 AS sentiment FROM w WHERE momentum IS NOT NULL AND volatility IS NOT NULL),
s AS (SELECT portfolio, day, {', '.join(_S)} FROM f), t AS (SELECT *, {', '.join(f'{x} AS t{i}' for i, x in enumerate(_T))} FROM s), b AS (SELECT portfolio, day, {_B} FROM t)
SELECT portfolio, CAST(day AS VARCHAR) AS day, {', '.join(f'round(b_{r} / ({_ALL}), 6) AS p_{r}' for r in outlook.REGIMES)} FROM b""")
def regime_blend(spark, sf):
    w = Window.partitionBy("portfolio").orderBy("day")
    r = risk.simple_returns(v.snapshots(spark, sf))
    volatility = F.try_divide(F.stddev_pop("r").over(w.rowsBetween(-5, 0)), F.stddev_pop("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = r.select("portfolio", "day", F.avg("r").over(w.rowsBetween(-5, 0)).alias("trend"), (F.col("value") / F.lag("value", 3).over(w) - 1).alias("momentum"), volatility.alias("volatility"))
    f = f.where("momentum is not null and volatility is not null").select("portfolio", "day", *[F.round(x, 9).alias(x) for x in ("trend", "momentum", "volatility")])
    return v.rounded(outlook.regimes(f).select("portfolio", "day", *[f"p_{r}" for r in outlook.REGIMES]))


@query(f"""WITH {v.RETURNS}, {v.POSITIONS}, a AS (SELECT portfolio, stddev_samp(r) * sqrt(12) AS vol FROM returns GROUP BY 1),
s AS (SELECT portfolio, symbol, sum(market_value) AS mv FROM positions GROUP BY 1, 2), w AS (SELECT portfolio, mv / sum(mv) OVER (PARTITION BY portfolio) AS w FROM s), h AS (SELECT portfolio, sum(w * w) AS hhi, max(w) AS top FROM w GROUP BY 1),
r AS (SELECT portfolio, unnest([{{'risk': 'drawdown', 'p': least(greatest(0.10e0 * least(2, vol / 0.15e0), 0.01e0), 0.80e0), 's': 0.3e0, 'x': 0.3e0}},
{{'risk': 'tail_event', 'p': 0.01e0 * 4 / 3 * 1.5e0, 's': 0.3e0, 'x': 0.3e0}}, {{'risk': 'volatility_spike', 'p': 0.05e0, 's': 0.3e0, 'x': 0.1e0}}, {{'risk': 'correlation_breakdown', 'p': 0.1e0, 's': 0.25e0, 'x': 0.15e0}},
{{'risk': 'liquidity', 'p': 0.05e0, 's': 0.4e0, 'x': 0.2e0}}, {{'risk': 'factor_crowding', 'p': 0e0, 's': 0.2e0, 'x': 0.1e0}},
{{'risk': 'concentration', 'p': greatest(CASE WHEN hhi > 0.25 THEN 0.4e0 WHEN hhi > 0.15 THEN 0.2e0 ELSE 0 END, CASE WHEN top > 0.2 THEN 0.5e0 WHEN top > 0.15 THEN 0.3e0 ELSE 0 END), 's': 0.3e0, 'x': 0.15e0}},
{{'risk': 'regime_shift', 'p': 0.15e0, 's': 0.35e0, 'x': 1e0 / 3}}]) AS k FROM a JOIN h USING (portfolio))
SELECT portfolio, k.risk AS risk, round(k.p, 6) AS probability, round(k.s, 6) AS severity, round(k.p * k.x, 6) AS expected_loss FROM r""")
def risk_outlook(spark, sf):
    vol = risk.simple_returns(v.snapshots(spark, sf)).groupBy("portfolio").agg((F.stddev_samp("r") * 12**0.5).alias("vol"))
    p = v.positions(spark, sf).groupBy("portfolio", "symbol").agg(F.sum("market_value").alias("mv"))
    w = p.join(p.groupBy("portfolio").agg(F.sum("mv").alias("total")), "portfolio").withColumn("w", F.col("mv") / F.col("total"))
    held = w.groupBy("portfolio").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max("w").alias("max_weight"))
    null = [F.lit(None).cast("double").alias(c) for c in "drawdown max_drawdown kurtosis skewness sector_share correlation liquidity days_to_sell factor_exposure vix_ratio".split()]
    return v.rounded(outlook.risk_outlook(vol.join(held, "portfolio").select("*", *null), "portfolio"))


_FACTS = "days_until_earnings pre_return revisions_up revisions_down iv_rank volume_ratio gap_up short_change payout coverage upgrades downgrades".split()


@query("""WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS up, count(*) FILTER (event_type = 'error') AS down, CAST(round(max(value)) AS BIGINT) AS iv, user_id % 40 AS days FROM events GROUP BY 1)
SELECT user_id, category, signal, round(strength, 6) AS strength FROM (SELECT user_id, 'earnings' AS category, CASE WHEN days <= 7 THEN 'imminent' ELSE 'upcoming' END AS signal, CASE WHEN days <= 7 THEN 0.9e0 ELSE 0.6e0 END AS strength FROM f WHERE days BETWEEN 0 AND 30
UNION ALL SELECT user_id, 'earnings', 'implied_volatility', 0.6e0 FROM f WHERE iv > 80 UNION ALL SELECT user_id, 'analyst', 'upgrades', least(0.8e0, 0.4e0 + 0.1e0 * up) FROM f WHERE up > 2 * down UNION ALL SELECT user_id, 'analyst', 'downgrades', least(0.8e0, 0.4e0 + 0.1e0 * down) FROM f WHERE down > 2 * up)""")
def signal_rules(spark, sf):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    f = v.table(spark, sf, "events").groupBy("user_id").agg(n("signup").alias("upgrades"), n("error").alias("downgrades"), F.round(F.max("value")).cast("long").alias("iv_rank"))
    f = f.withColumn("days_until_earnings", F.col("user_id") % 40)
    return v.rounded(outlook.signals(f.select("*", *[F.lit(None).cast("double").alias(c) for c in _FACTS if c not in f.columns]), "user_id"))


@query(f"""WITH {v.POSITIONS}, p AS (SELECT portfolio, market_value, 0.5e0 + CAST(substr(symbol, 7) AS INT) / 20e0 AS x FROM positions),
g AS (SELECT portfolio, k / 64e0 AS severity, sum(market_value * least(x * k / 64e0, 1e0)) AS loss, sum(market_value) AS value FROM p, range(1, 65) t(k) GROUP BY 1, 2)
SELECT portfolio, round(min(severity), 6) AS severity, round(min(loss), 4) AS loss FROM g WHERE loss >= 0.3e0 * value - 1e-9 * value GROUP BY 1""")
def reverse_stress(spark, sf):
    p = v.positions(spark, sf).withColumn("sensitivity", 0.5 + F.substring("symbol", 7, 9).cast("int") / 20.0)
    return outlook.reverse_stress(p, "portfolio", 0.3, steps=64).select("portfolio", F.round("severity", 6).alias("severity"), F.round("loss", 4).alias("loss"))


@query()
def bootstrap_paths(spark, sf):
    paths = outlook.bootstrap_paths(risk.simple_returns(v.snapshots(spark, sf)), "portfolio", "r", 200, 252)
    return v.rounded(outlook.path_summary(paths, "portfolio"))


@query(f"""WITH m AS (SELECT user_id AS entity, CASE event_type WHEN 'click' THEN 'rule' WHEN 'purchase' THEN 'dictionary' WHEN 'view' THEN 'context' WHEN 'signup' THEN 'ner' ELSE 'other' END AS signal FROM events),
e AS (SELECT entity, signal, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT e.*, coalesce(s.value, 0.5e0) AS value, coalesce(s.weight, 1e0) AS weight FROM e LEFT JOIN (VALUES {', '.join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in recognition.SIGNALS.items())}) s(signal, value, weight) ON s.signal = e.signal),
g AS (SELECT entity, sum(value * weight) AS got, sum(weight) AS weight, CAST(sum(n) AS BIGINT) AS mentions FROM k GROUP BY 1)
SELECT entity, mentions, round(least(1, greatest(0.3e0, CASE WHEN mentions > 1 THEN (got + 0.5e0 * least(0.05e0 * (mentions - 1), 0.2e0)) / (weight + 0.5e0) ELSE got / weight END)), 6) AS confidence FROM g""")
def entity_confidence(spark, sf):
    kind = F.col("event_type")
    signal = F.when(kind == "click", "rule").when(kind == "purchase", "dictionary").when(kind == "view", "context").when(kind == "signup", "ner").otherwise("other")
    m = v.table(spark, sf, "events").select(F.col("user_id").alias("entity"), signal.alias("signal"))
    return v.rounded(recognition.entity_confidence(m, ["entity"]))


@query("""WITH t AS (SELECT DISTINCT upper(replace(p_brand, '#', '')) AS ticker, upper(p_brand || ' plc') AS alias FROM part), m AS (SELECT DISTINCT unnest([p_brand, lower(replace(p_brand, '#', '')), replace(p_brand, '#', '') || '.US', p_brand || ' plc', p_name]) AS mention FROM part),
x AS (SELECT mention, upper(mention) AS name FROM m), k AS (SELECT mention, ticker, CASE WHEN name = ticker THEN 0.98e0 WHEN name = ticker || '.US' THEN 0.95e0 WHEN name = alias THEN 0.9e0 WHEN levenshtein(name, ticker) = 1 THEN 0.7e0 END AS confidence FROM x JOIN t ON name = ticker OR name = ticker || '.US' OR name = alias OR (length(name) >= 3 AND length(ticker) >= 3 AND levenshtein(name, ticker) = 1)),
b AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY confidence DESC, ticker) AS r FROM k) SELECT m.mention, b.ticker, b.confidence FROM m LEFT JOIN b ON b.mention = m.mention AND r = 1""")
def ticker_resolution(spark, sf):
    part = v.table(spark, sf, "part")
    bare = F.replace("p_brand", F.lit("#"), F.lit(""))
    listed = part.select(bare.alias("ticker"), F.concat("p_brand", F.lit(" plc")).alias("alias")).distinct()
    m = part.select(F.explode(F.array(F.col("p_brand"), F.lower(bare), F.concat(bare, F.lit(".US")), F.concat("p_brand", F.lit(" plc")), F.col("p_name"))).alias("mention"))
    return recognition.resolve_tickers(m, listed)


@query("""WITH m AS (SELECT unnest([s_name, upper(s_name), replace(s_name, '#', ' ') || ', Inc.', 'Vendor ' || s_suppkey, 'unknown ' || s_suppkey]) AS mention, unnest([s_name, s_name, s_name, s_name, NULL]) AS company, unnest([0.98e0, 0.98e0, 0.9e0, 0.95e0, NULL]) AS confidence FROM supplier)
SELECT DISTINCT mention, company, confidence FROM m""")
def company_resolution(spark, sf):
    s = v.table(spark, sf, "supplier")
    vendor = F.concat(F.lit("Vendor "), "s_suppkey")
    companies = s.select(F.col("s_name").alias("company"), vendor.alias("alias"))
    m = s.select(F.explode(F.array(F.col("s_name"), F.upper("s_name"), F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(", Inc.")), vendor, F.concat(F.lit("unknown "), "s_suppkey"))).alias("mention"))
    return recognition.resolve_companies(m, companies)


_WORDS = {"heat": (["cold"], ["hot"]), "size": (["small"], ["large", "big"]), "thing": (["ring"], ["widget", "bolt"])}
_SIDES = " UNION ALL ".join("SELECT p_brand, p_partkey, '{}' AS lexicon, {} AS up, {} AS down FROM part".format(k, *["(" + " OR ".join(f"contains(lower(p_name), '{w}')" for w in x) + ")" for x in ab]) for k, ab in _WORDS.items())


@query(f"""WITH s AS ({_SIDES}) SELECT a.p_brand, a.p_partkey, a.lexicon, count(*) AS opposing FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.lexicon = b.lexicon AND a.p_partkey <> b.p_partkey AND ((a.up AND b.down) OR (a.down AND b.up)) GROUP BY 1, 2, 3""")
def opposing_claims(spark, sf):
    return recognition.opposed(v.table(spark, sf, "part"), "p_brand", "p_partkey", "p_name", _WORDS)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '10k' WHEN o_orderkey % 4 = 1 THEN '10q' WHEN o_orderkey % 4 = 2 THEN '8k' END AS form, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(NULL AS VARCHAR) AS accession,
CASE WHEN o_orderkey % 4 < 3 THEN CAST(year(o_orderdate) AS INT) END AS fiscal_year, CASE WHEN o_orderkey % 4 = 1 THEN CAST(quarter(o_orderdate) AS INT) END AS fiscal_quarter FROM orders""")
def filing_metadata(spark, sf):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    head = F.when(k == 0, "FORM 10-K\n").when(k == 1, F.concat(F.lit("Form 10 Q, fiscal quarter "), F.quarter(day).cast("string"), F.lit(" report\n"))).when(k == 2, "form 8-K, current report\n").otherwise("Letter\n")
    year = F.when(k < 3, F.concat(F.lit("for the fiscal year ended December 31, "), F.year(day).cast("string"))).otherwise("year ended never")
    text = F.concat(head, F.lit("Central Index Key: "), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("\n"), year)
    return recognition.filing_metadata(v.table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")


@query("""SELECT doc_id, CAST(len(list_distinct([trim(x, ' ') FOR x IN string_split(lower(text), '.') IF regexp_matches(x, 'the|und')])) AS BIGINT) AS sentences FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), 'the|und')""")
def keyword_sentences(spark, sf):
    return recognition.keyword_sentences(v.table(spark, sf, "documents"), ["the", "und"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'view' THEN 'neutral' WHEN value > 100 THEN 'positive' ELSE 'negative' END AS polarity FROM events""")
def event_polarity(spark, sf):
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "dividend").when(kind == "error", "lawsuit").otherwise("other")
    mood = F.when(kind == "view", None).when(F.col("value") > 100, "positive").otherwise("negative")
    return v.table(spark, sf, "events").select("event_id", recognition.event_polarity(event, mood).alias("polarity"))


_EV = ""
for _k in range(4):
    _EV += f""", r{_k + 1} AS MATERIALIZED (SELECT s.id, s.score + g.got AS score FROM v{_k} s JOIN (SELECT u.src, sum(v.score) AS got FROM und u JOIN v{_k} v ON v.id = u.dst GROUP BY 1) g ON g.src = s.id), v{_k + 1} AS MATERIALIZED (SELECT id, score / (SELECT max(score) FROM r{_k + 1}) AS score FROM r{_k + 1})"""


@query(f"""WITH {EDGES}, v0 AS (SELECT DISTINCT src AS id, 1e0 AS score FROM und){_EV} SELECT id, round(score, 6) AS score FROM v4""")
def eigenvector_centrality(spark, sf):
    return v.rounded(graph.eigenvector(edges(spark, sf), rounds=4))


@query()
def blended_centrality(spark, sf):
    return v.rounded(graph.blended_centrality(edges(spark, sf), samples=100), 9)
