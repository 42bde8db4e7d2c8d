"""Indicator and pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import indicators as ind
from orrery.plans import views as v
from orrery.plans.registry import query

O = "(PARTITION BY symbol ORDER BY day{})"  # noqa: E741
WIN = "w{0} AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {1} PRECEDING AND CURRENT ROW)"


def w(*ns):
    return "WINDOW o AS (PARTITION BY symbol ORDER BY day), " + ", ".join(WIN.format(n, n - 1) for n in ns)


def _ema(n):
    a = 2.0 / (n + 1)
    terms = [f"lag(close, {n - 1}) OVER o * {(1 - a) ** (n - 1)!r}"] + [f"lag(close, {k}) OVER o * {a * (1 - a) ** k!r}" for k in range(n - 1)]
    return f"CASE WHEN row_number() OVER o >= {n} THEN round({' + '.join(terms)}, 2) END"


LABEL = "CASE WHEN {0} >= 0.85 THEN 'very_high' WHEN {0} >= 0.7 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' WHEN {0} >= 0.3 THEN 'low' ELSE 'very_low' END"


@query(f"""WITH {v.BARS}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS b FROM bars), q AS (SELECT symbol, day, close, row_number() OVER o AS n, avg(close) OVER w20 AS s20, avg(close) OVER w50 AS s50, avg(close) OVER w200 AS s200, stddev_pop(close) OVER w20 AS sd,
 avg(greatest(close - b, 0)) OVER w14 AS g, avg(greatest(b - close, 0)) OVER w14 AS l FROM p {w(14, 20, 50, 200)})
SELECT symbol, CAST(day AS VARCHAR) AS day, round(s20, 4) AS sma_20, round(s50, 4) AS sma_50, round(s200, 4) AS sma_200, round(s20 + 2 * sd, 4) AS bb_upper, round(s20 - 2 * sd, 4) AS bb_lower, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 2) AS rsi_14 FROM q WHERE n >= 200""")
def technical_indicators(spark, sf):
    return v.rounded(ind.technical(v.bars(spark, sf)).select("symbol", "day", "sma_20", "sma_50", "sma_200", "bb_upper", "bb_lower", "rsi_14"), 4)


@query(f"""WITH {v.BARS}, q AS (SELECT symbol, day, row_number() OVER o AS n, {_ema(12)} AS ema_12, {_ema(26)} AS ema_26 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, CAST(day AS VARCHAR) AS day, ema_12, ema_26, round(ema_12 - ema_26, 2) AS macd FROM q WHERE n >= 200""")
def ema_macd(spark, sf):
    return v.rounded(ind.technical(v.bars(spark, sf)).select("symbol", "day", "ema_12", "ema_26", "macd"), 2)


@query(f"""WITH RECURSIVE {v.BARS}, k AS MATERIALIZED (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM bars),
e AS (SELECT symbol, day, n, close AS ema FROM k WHERE n = 1 UNION ALL SELECT k.symbol, k.day, k.n, 2e0 / 21 * k.close + (1 - 2e0 / 21) * e.ema FROM e JOIN k ON k.symbol = e.symbol AND k.n = e.n + 1)
SELECT symbol, CAST(day AS VARCHAR) AS day, round(ema, 4) AS ema FROM e""")
def ema_full(spark, sf):
    return v.rounded(ind.ema_recursive(v.bars(spark, sf), 20), 4)


@query(f"""WITH {v.BARS} SELECT symbol, CAST(day AS VARCHAR) AS day, close, {', '.join(f'lag(close, {k}) OVER o AS lag_{k}' for k in (1, 2, 3, 5, 10, 20, 60))},
 {', '.join(f'round(CASE WHEN count(*) OVER w{n} = {n} THEN avg(close) OVER w{n} END, 4) AS mean_{n}, round(CASE WHEN count(*) OVER w{n} = {n} THEN stddev_pop(close) OVER w{n} END, 4) AS std_{n}' for n in (5, 10, 20, 60))},
 {', '.join(f'close - lag(close, {k}) OVER o AS momentum_{k}' for k in (5, 20))}, CAST(isodow(day) - 1 AS INT) AS weekday, CAST(month(day) AS INT) AS month, CAST(quarter(day) AS INT) AS quarter FROM bars {w(5, 10, 20, 60)}""")
def forecast_features(spark, sf):
    d = ind.features(v.bars(spark, sf)).withColumn("day", F.col("day").cast("string"))
    return d.select(*[F.round(c, 4).alias(c) if c.startswith(("mean", "std")) else c for c in d.columns])


_T = "SELECT symbol, {0} AS span, regr_slope(close, -k) AS slope, corr(close, -k) AS c, count(*) AS n FROM k WHERE k <= {0} GROUP BY symbol"


@query(f"""WITH {v.BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM bars), t AS ({' UNION ALL '.join(_T.format(n) for n in (20, 50, 100))})
SELECT symbol, span, round(slope, 6) AS slope, round(abs(c), 6) AS strength, CASE WHEN abs(c) > 0.7 THEN 'strong' WHEN abs(c) > 0.4 THEN 'weak' ELSE 'none' END AS label, CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction FROM t WHERE n = span""")
def trend_detection(spark, sf):
    return v.rounded(ind.trends(v.bars(spark, sf)))


@query(f"""WITH {v.BARS}, g AS (SELECT symbol, day, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END - CASE WHEN count(*) OVER w200 = 200 THEN avg(close) OVER w200 END AS gap FROM bars {w(50, 200)}), b AS (SELECT *, lag(gap) OVER (PARTITION BY symbol ORDER BY day) AS p FROM g)
SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN gap > 0 THEN 'golden_cross' ELSE 'death_cross' END AS direction FROM b WHERE (p <= 0 AND gap > 0) OR (p >= 0 AND gap < 0)""")
def golden_death_cross(spark, sf):
    return v.rounded(ind.crosses(v.bars(spark, sf)).select("symbol", "day", "direction"))


@query(f"""WITH {v.BARS}, a AS (SELECT *, max(high) OVER b AS hi, min(low) OVER b AS lo, count(*) OVER b AS n, volume / avg(volume) OVER w20 AS ratio FROM bars {w(20)}, b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, lag(close) OVER o AS pc, lag(hi) OVER o AS ph, lag(lo) OVER o AS pl, lag(n) OVER o AS pn FROM a WINDOW o AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN close > hi THEN 'up' ELSE 'down' END AS direction, round(least(ratio / 3, 1), 6) AS score FROM p WHERE pn = 20 AND ratio > 1.5 AND ((close > hi AND pc <= ph) OR (close < lo AND pc >= pl))""")
def donchian_breakout(spark, sf):
    return v.rounded(ind.breakouts(v.bars(spark, sf)).select("symbol", "day", "direction", "score"))


_Z = """z AS (SELECT symbol, day, (x - avg(x) OVER w{0}) / nullif(stddev_samp(x) OVER w{0}, 0) AS z, count(x) OVER w{0} AS n FROM x {1}) SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction, round(least(abs(z) / 5, 1), 6) AS score, """ + LABEL.format("least(abs(z) / 5, 1)") + " AS confidence FROM z WHERE n = {0} AND {2} > 3"


@query(f"WITH {v.BARS}, x AS (SELECT symbol, day, CAST(volume AS DOUBLE) AS x FROM bars), " + _Z.format(30, w(30), "z"))
def volume_spikes(spark, sf):
    return v.rounded(ind.volume_spikes(v.bars(spark, sf)).drop("pattern"))


@query(f"WITH {v.BARS}, x AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM bars), " + _Z.format(60, w(60), "abs(z)"))
def return_anomalies(spark, sf):
    return v.rounded(ind.anomalies(v.bars(spark, sf)).drop("pattern"))


@query(f"""WITH {v.BARS}, x AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM bars), y AS (SELECT symbol, day, CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END AS vol FROM x {w(20)}),
z AS (SELECT symbol, day, CASE WHEN count(vol) OVER w60 = 60 THEN (vol - avg(vol) OVER w60) / nullif(stddev_samp(vol) OVER w60, 0) END AS z FROM y {w(60)}), f AS (SELECT *, coalesce(abs(z) > 2, false) AS f, lag(coalesce(abs(z) > 2, false), 1, false) OVER (PARTITION BY symbol ORDER BY day) AS was FROM z)
SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction, round(least(abs(z) / 4, 1), 6) AS score FROM f WHERE f AND NOT was""")
def regime_onsets(spark, sf):
    return v.rounded(ind.regime_changes(v.bars(spark, sf)).select("symbol", "day", "direction", "score"))


def _ext(n):
    return f"""e0 AS (SELECT *, count(*) OVER b AS nb, count(*) OVER a AS na, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la FROM bars
 WINDOW b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)),
ext AS (SELECT symbol, day, 'top' AS kind, high AS price FROM e0 WHERE nb = {n} AND na = {n} AND high > hb AND high > ha UNION ALL SELECT symbol, day, 'bottom', low FROM e0 WHERE nb = {n} AND na = {n} AND low < lb AND low < la)"""


@query(f"""WITH {v.BARS}, {_ext(20)}, n AS (SELECT *, coalesce(CAST(price - lag(price) OVER (PARTITION BY symbol, kind ORDER BY price, day) > 2e0 AS INT), 1) AS fresh FROM ext), l AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, kind ORDER BY price, day ROWS UNBOUNDED PRECEDING) AS level FROM n)
SELECT symbol, CAST(max(day) AS VARCHAR) AS day, CASE WHEN kind = 'top' THEN 'resistance' ELSE 'support' END AS type, round(avg(price), 4) AS price, count(*) AS touch_count, round(least(count(*) / 10e0, 1), 6) AS score FROM l GROUP BY symbol, kind, level HAVING count(*) >= 3""")
def support_resistance(spark, sf):
    return v.rounded(ind.support_resistance(v.bars(spark, sf), eps=2.0), 4)


@query(f"""WITH {v.BARS}, {_ext(10)}, p AS (SELECT *, lead(day) OVER o AS day2, lead(price) OVER o AS price2 FROM ext WINDOW o AS (PARTITION BY symbol, kind ORDER BY day)), q AS (SELECT * FROM p WHERE abs(price2 - price) / price <= 0.03e0),
g AS (SELECT q.symbol, q.kind, q.day, q.day2, (q.price + q.price2) / 2 AS level, CASE WHEN q.kind = 'top' THEN min(b.low) ELSE max(b.high) END AS neck FROM q JOIN bars b ON b.symbol = q.symbol AND b.day > q.day AND b.day < q.day2 GROUP BY q.symbol, q.kind, q.day, q.day2, q.price, q.price2)
SELECT symbol, CAST(day2 AS VARCHAR) AS day, CASE WHEN kind = 'top' THEN 'double_top' ELSE 'double_bottom' END AS pattern, round(level, 4) AS peak_price, round(neck, 4) AS neck, round(2 * neck - level, 4) AS target_price, round(abs(level - neck) / level, 4) AS depth FROM g WHERE abs(level - neck) / level > 0.05e0""")
def double_top_bottom(spark, sf):
    return v.rounded(ind.reversals(v.bars(spark, sf)), 4)


@query(f"""WITH {v.BARS}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), g AS (SELECT a.symbol, k AS lag, corr(a.close, b.close) AS c FROM n a CROSS JOIN range(1, 41) t(k) JOIN n b ON a.symbol = b.symbol AND b.i = a.i - k WHERE k <= a.n / 4 GROUP BY 1, 2),
p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY lag) AS a, lead(c) OVER (PARTITION BY symbol ORDER BY lag) AS b FROM g), h AS (SELECT * FROM p WHERE c > a AND c > b AND c >= -1), m AS (SELECT *, max(c) OVER (PARTITION BY symbol ORDER BY lag RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mx FROM h)
SELECT symbol, CAST(lag AS INT) AS lag, round(c, 6) AS corr FROM m WHERE c >= mx AND c > -1 AND lag > 5""")
def autocorrelation_cycles(spark, sf):
    return v.rounded(ind.cycles(v.bars(spark, sf), longest=40, height=-1, least=-1))


@query()
def fft_seasonality(spark, sf):
    return v.rounded(ind.seasonality(v.bars(spark, sf)))


@query(f"""WITH {v.BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM bars), z AS (SELECT symbol, k, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_pop(close) OVER (PARTITION BY symbol) AS z FROM k WHERE k <= 60)
SELECT a.symbol, round(sqrt(sum(pow(a.z - b.z, 2))), 6) AS distance, round(1 / (1 + sqrt(sum(pow(a.z - b.z, 2)))), 6) AS similarity FROM z a JOIN z b ON a.k = b.k AND b.symbol = 'Brand#11' WHERE a.symbol <> 'Brand#11' GROUP BY 1""")
def similar_patterns(spark, sf):
    return v.rounded(ind.similar(v.bars(spark, sf), "Brand#11"))


@query()
def pattern_dispatch(spark, sf):
    return v.rounded(ind.detect(v.bars(spark, sf)).groupBy("pattern", "direction", "confidence").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))
