"""Risk and return queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import risk
from orrery.plans import views as v
from orrery.plans.registry import query


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return risk.simple_returns(v.snapshots(spark, sf))


def _market(spark: SparkSession, sf: str) -> DataFrame:
    m = v.benchmark_returns(spark, sf).withColumn("portfolio", F.lit("all"))
    return risk.simple_returns(m, name="b").select("day", "b")


@query(f"WITH {v.RETURNS} SELECT portfolio, CAST(day AS VARCHAR) AS day, round(r, 6) AS r FROM returns")
def simple_returns(spark, sf):
    return v.rounded(_returns(spark, sf).select("portfolio", "day", "r"))


@query(f"""WITH {v.SNAPSHOTS}, a AS (SELECT *, coalesce(CAST(value > max(value) OVER (PARTITION BY portfolio ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 0) AS fresh,
 max(value) OVER (PARTITION BY portfolio ORDER BY day) AS peak FROM snapshots), b AS (SELECT *, sum(fresh) OVER (PARTITION BY portfolio ORDER BY day) AS run FROM a)
SELECT portfolio, CAST(day AS VARCHAR) AS day, round((peak - value) / peak, 6) AS drawdown, CAST(row_number() OVER (PARTITION BY portfolio, run ORDER BY day) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS INT) AS duration FROM b""")
def drawdown_series(spark, sf):
    return v.rounded(risk.drawdowns(v.snapshots(spark, sf)).select("portfolio", "day", "drawdown", "duration"))


@query(f"""WITH {v.RETURNS}, c AS (SELECT portfolio, quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99 FROM returns GROUP BY 1),
s AS (SELECT portfolio, avg(r) FILTER (r <= v95) AS c95, avg(r) FILTER (r <= v99) AS c99 FROM returns JOIN c USING (portfolio) GROUP BY 1),
m AS (SELECT portfolio, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS std, stddev_pop(r) FILTER (r < 0) AS down, stddev_pop(r - 2e-2/252) FILTER (r < 2e-2/252) AS downx, avg(r - 2e-2/252) AS ex, sum(ln(1 + r)) AS lg, kurtosis_pop(r) AS k FROM returns GROUP BY 1),
m3 AS (SELECT portfolio, avg(pow(r - mean, 3)) / pow(avg(pow(r - mean, 2)), 1.5) AS sk FROM returns JOIN m USING (portfolio) GROUP BY 1),
a AS (SELECT *, coalesce(CAST(value > max(value) OVER (PARTITION BY portfolio ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 0) AS fresh, max(value) OVER (PARTITION BY portfolio ORDER BY day) AS peak FROM returns),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY portfolio ORDER BY day) AS run FROM a),
d AS (SELECT portfolio, max(dd) AS mdd, max(du) AS mdu FROM (SELECT portfolio, (peak - value) / peak AS dd, row_number() OVER (PARTITION BY portfolio, run ORDER BY day) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS du FROM b) GROUP BY 1)
SELECT portfolio, n, round(v95, 6) AS var_95, round(c95, 6) AS cvar_95, round(v99, 6) AS var_99, round(c99, 6) AS cvar_99, round(std * sqrt(252), 6) AS volatility, round(coalesce(down, 0) * sqrt(252), 6) AS downside_volatility,
 round(exp(lg) - 1, 6) AS total_return, round(lg * 252 / n, 6) AS log_annual_return, round(ex / std * sqrt(252), 6) AS sharpe, round(ex / downx * sqrt(252), 6) AS sortino, round(sk, 6) AS skewness, round(k, 6) AS kurtosis, round(mdd, 6) AS max_drawdown, CAST(mdu AS BIGINT) AS max_duration
FROM m JOIN c USING (portfolio) JOIN s USING (portfolio) JOIN m3 USING (portfolio) JOIN d USING (portfolio)""")
def risk_wide_row(spark, sf):
    return v.rounded(risk.risk_row(_returns(spark, sf)))


@query(f"WITH {v.RETURNS} SELECT portfolio, round(quantile_cont(r, 0.05), 6) AS \"var\", round(coalesce(abs(quantile_cont(r, 0.95) / nullif(quantile_cont(r, 0.05), 0)), 0), 6) AS tail_ratio FROM returns GROUP BY 1")
def historical_var_tail(spark, sf):
    return v.rounded(_returns(spark, sf).groupBy("portfolio").agg(risk.value_at_risk().alias("var"), risk.tail_ratio().alias("tail_ratio")))


@query(f"""WITH {v.RETURNS}, {v.MARKET} SELECT portfolio, round(regr_slope(r, b), 6) AS beta, round(regr_intercept(r, b) * 252, 6) AS alpha, round(corr(r, b), 6) AS correlation,
 round(stddev_pop(r - b) * sqrt(252), 6) AS tracking_error, round(avg(r - b) / nullif(stddev_pop(r - b), 0) * sqrt(252), 6) AS information_ratio FROM returns JOIN market USING (day) GROUP BY 1""")
def benchmark_comparison(spark, sf):
    return v.rounded(risk.against_benchmark(_returns(spark, sf), _market(spark, sf)))


@query(f"""WITH {v.RETURNS}, e AS (SELECT portfolio, arg_min(value, day) AS f, arg_max(value, day) AS l FROM snapshots GROUP BY 1), g AS (SELECT portfolio, count(*) AS n, stddev_pop(r) AS s, avg(CAST(r > 0 AS DOUBLE)) AS w FROM returns GROUP BY 1)
SELECT portfolio, n, round((l - f) / f, 6) AS total_return, round((l - f) / f * 252 / n, 6) AS annual_return, round(s * sqrt(252), 6) AS volatility, round(w, 6) AS win_share FROM e JOIN g USING (portfolio)""")
def period_performance(spark, sf):
    return v.rounded(risk.performance(v.snapshots(spark, sf)))


@query(f"""WITH {v.RETURNS} SELECT portfolio, round(skewness(r), 6) AS skew_sample, round(kurtosis(r), 6) AS kurtosis_sample, round((avg(r) * 252 - 2e-2) / (stddev_samp(r) * sqrt(252)), 6) AS sharpe FROM returns GROUP BY 1""")
def corrected_moments(spark, sf):
    return v.rounded(risk.corrected_moments(_returns(spark, sf)))


@query(f"""WITH {v.POSITIONS}, h AS (SELECT portfolio, symbol, sum(market_value) AS x FROM positions GROUP BY 1, 2), w AS (SELECT *, x / sum(x) OVER (PARTITION BY portfolio) AS w FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY w DESC, symbol) AS k FROM w), g AS (SELECT portfolio, count(*) AS n, sum(w * w) AS hhi, max(w) AS max_weight, arg_min(symbol, k) AS largest, sum(w) FILTER (k <= 5) AS top5, sum(w) FILTER (k <= 10) AS top10 FROM k GROUP BY 1)
SELECT portfolio, n, round(hhi, 6) AS hhi, round(max_weight, 6) AS max_weight, largest, round(top5, 6) AS top5, round(top10, 6) AS top10, round((hhi - 1.0 / n) / (1 - 1.0 / n), 6) AS hhi_normalised, round(1 / hhi, 6) AS effective FROM g""")
def concentration(spark, sf):
    return v.rounded(risk.concentration(v.positions(spark, sf)))


@query(f"WITH {v.POSITIONS}, g AS (SELECT portfolio, coalesce(sector, 'Unknown') AS sector, sum(market_value) AS x FROM positions GROUP BY 1, 2) SELECT portfolio, sector, round(x, 2) AS value, round(x / sum(x) OVER (PARTITION BY portfolio), 6) AS weight FROM g")
def sector_exposure(spark, sf):
    return risk.exposure(v.positions(spark, sf)).select("portfolio", "sector", F.round("value", 2).alias("value"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {v.BARS}, {v.POSITIONS}, a AS (SELECT symbol, avg(volume) AS adv FROM bars GROUP BY 1), d AS (SELECT *, quantity / (adv * 0.2e0) AS days FROM positions JOIN a USING (symbol))
SELECT portfolio, round(sum(market_value * adv) / sum(market_value), 4) AS weighted_adv, round(max(days), 4) AS days_to_liquidate, round(sum(market_value * days) / sum(market_value), 4) AS weighted_days FROM d GROUP BY 1""")
def liquidity_profile(spark, sf):
    adv = v.bars(spark, sf).groupBy("symbol").agg(F.avg("volume").alias("adv"))
    return v.rounded(risk.liquidity(v.positions(spark, sf), adv), 4)


_PAIR = "SELECT x.portfolio AS a, y.portfolio AS b, round(corr(x.{0}, y.{0}), 6) AS correlation, round(covar_samp(x.{0}, y.{0}), 6) AS covariance, count(*) AS n FROM {1} x JOIN {1} y ON x.day = y.day AND x.portfolio < y.portfolio GROUP BY 1, 2"


@query(f"WITH {v.RETURNS} {_PAIR.format('r', 'returns')}")
def correlation_pearson(spark, sf):
    return v.rounded(risk.pairwise_correlation(_returns(spark, sf)))


@query(f"WITH {v.RETURNS}, k AS (SELECT portfolio, day, rank() OVER (PARTITION BY portfolio ORDER BY r) + (count(*) OVER (PARTITION BY portfolio, r) - 1) / 2e0 AS q FROM returns) {_PAIR.format('q', 'k')}")
def correlation_spearman(spark, sf):
    return v.rounded(risk.pairwise_correlation(_returns(spark, sf), method="spearman"))


@query(f"""WITH {v.RETURNS}, p AS (SELECT x.portfolio AS a, y.portfolio AS b, x.day, x.r AS xa, y.r AS xb FROM returns x JOIN returns y ON x.day = y.day AND x.portfolio < y.portfolio)
SELECT p.a, p.b, round(sum(sign(p.xa - q.xa) * sign(p.xb - q.xb)) / sqrt(sum(abs(sign(p.xa - q.xa))) * sum(abs(sign(p.xb - q.xb)))), 6) AS tau FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.day < q.day GROUP BY 1, 2""")
def correlation_kendall(spark, sf):
    return v.rounded(risk.kendall(_returns(spark, sf)))


@query(f"""WITH {v.RETURNS}, c AS (SELECT x.portfolio AS i, y.portfolio AS j, covar_samp(x.r, y.r) AS cov FROM returns x JOIN returns y ON x.day = y.day GROUP BY 1, 2),
w AS (SELECT portfolio AS i, 0.2e0 AS w FROM (SELECT DISTINCT portfolio FROM returns)), k AS (SELECT c.i, sum(cov * w.w) AS cw, 0.2e0 AS w FROM c JOIN w ON c.j = w.i GROUP BY 1), s AS (SELECT sqrt(sum(w * cw)) AS sigma FROM k)
SELECT i AS portfolio, w, round(cw / sigma, 6) AS mcr, round(w * cw / sigma, 6) AS ccr, round(w * cw / pow(sigma, 2), 6) AS share, round(sigma * 1.6448536269514722e0, 6) AS portfolio_var FROM k, s""")
def covariance_decomposition(spark, sf):
    r = _returns(spark, sf)
    weights = r.select("portfolio").distinct().withColumn("w", F.lit(0.2))
    return v.rounded(risk.covariance_decomposition(r, weights, key="portfolio"))


SHOCKS = [("market_crash", None, -0.2), ("sector_rotation", "BRASS", -0.15), ("sector_rotation", "STEEL", 0.1), ("boom", None, 0.1), ("boom", "TIN", 0.25)]


@query(f"""WITH {v.POSITIONS}, d AS (SELECT portfolio, sector, sum(market_value) AS v FROM positions GROUP BY 1, 2), s AS (SELECT * FROM (VALUES ('market_crash', NULL, -0.2e0), ('sector_rotation', 'BRASS', -0.15e0), ('sector_rotation', 'STEEL', 0.1e0), ('boom', NULL, 0.1e0), ('boom', 'TIN', 0.25e0)) t(scenario, sector, shock)),
n AS (SELECT DISTINCT scenario FROM s), g AS (SELECT d.*, n.scenario, coalesce(o.shock, e.shock, 0) AS shock FROM d CROSS JOIN n LEFT JOIN s o ON o.scenario = n.scenario AND o.sector = d.sector LEFT JOIN s e ON e.scenario = n.scenario AND e.sector IS NULL)
SELECT portfolio, scenario, round(sum(v * shock), 2) AS pnl, round(sum(v), 2) AS value, round(sum(v * shock) / sum(v), 6) AS pnl_share FROM g GROUP BY 1, 2""")
def scenario_losses(spark, sf):
    d = risk.scenarios(v.positions(spark, sf), spark.createDataFrame(SHOCKS, "scenario string, sector string, shock double"))
    return d.select("portfolio", "scenario", F.round("pnl", 2).alias("pnl"), F.round("value", 2).alias("value"), F.round("pnl_share", 6).alias("pnl_share"))


@query(f"WITH {v.RETURNS} SELECT portfolio, CAST(day AS VARCHAR) AS day, round(row_number() OVER (PARTITION BY portfolio ORDER BY r, day) / (count(*) OVER (PARTITION BY portfolio) + 1e0), 6) AS u FROM returns")
def rank_transform(spark, sf):
    return v.rounded(risk.rank_transform(_returns(spark, sf).select("portfolio", "day", "r"), "portfolio", "r").select("portfolio", "day", "u"))


@query("""SELECT x AS theta, round(CASE WHEN x > 0 THEN pow(2, -1 / x) ELSE 0 END, 6) AS clayton_lower, round(2 - pow(2, 1 / x), 6) AS gumbel_upper FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part WHERE p_size > 0)""")
def copula_tail_dependence(spark, sf):
    d = v.table(spark, sf, "part").where("p_size > 0").select(F.col("p_size").cast("double").alias("theta")).distinct()
    return v.rounded(d.select("theta", risk.tail_dependence("clayton", F.col("theta"))[0].alias("clayton_lower"), risk.tail_dependence("gumbel", F.col("theta"))[1].alias("gumbel_upper")))


@query(f"""WITH {v.RETURNS}, k AS (SELECT portfolio, 'volatility' AS metric, stddev_pop(r) * sqrt(252) AS value FROM returns GROUP BY 1) SELECT portfolio, metric, round(value, 6) AS value, 12e0 AS budget, CASE WHEN value > 12 * 1.1e0 THEN 'violation' WHEN value > 12 * 0.9e0 THEN 'warning' ELSE 'ok' END AS status FROM k""")
def risk_budget(spark, sf):
    r = _returns(spark, sf).groupBy("portfolio").agg((F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("value")).withColumn("metric", F.lit("volatility"))
    budgets = r.select("portfolio", "metric", F.lit(12.0).alias("budget"))
    return v.rounded(risk.budget_breaches(r, budgets).select("portfolio", "metric", "value", "budget", "status"))
