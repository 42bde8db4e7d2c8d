"""Returns, drawdowns and risk measures. Every operator takes and returns DataFrames; rows are grouped by `by` columns,
time comes from an explicit, ascending order column, and standard deviations are of the population unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252.0


def simple_returns(df: DataFrame, by: str = "portfolio", ts: str = "day", value: str = "value", name: str = "r") -> DataFrame:
    """(v - prev) / prev per key in time order; rows without a positive predecessor go."""
    prev = F.lag(value).over(Window.partitionBy(by).orderBy(ts))
    return df.withColumn("_prev", prev).where("_prev > 0").withColumn(name, (F.col(value) - F.col("_prev")) / F.col("_prev")).drop("_prev")


def drawdowns(df: DataFrame, by: str = "portfolio", ts: str = "day", value: str = "value") -> DataFrame:
    """Adds peak, drawdown and duration: rows since the last strict new peak; the first row and ties count as one."""
    w = Window.partitionBy(by).orderBy(ts)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.coalesce((F.col(value) > before).cast("int"), F.lit(0)))
    d = d.withColumn("peak", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.row_number().over(Window.partitionBy(by, "_run").orderBy(ts))
    d = d.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak")).otherwise(0.0))
    return d.withColumn("duration", F.when(F.col("_run") > 0, inside - 1).otherwise(inside)).drop("_new", "_run")


def value_at_risk(r: str = "r", confidence: float = 0.95) -> Column:
    """Historical VaR: the (1 - confidence) percentile, linearly interpolated."""
    return F.percentile(r, round(1 - confidence, 10))


def expected_shortfall(df: DataFrame, by: str = "portfolio", r: str = "r", confidence: float = 0.95) -> DataFrame:
    """(by, var, cvar): the mean of returns at or below VaR."""
    cut = df.groupBy(by).agg(value_at_risk(r, confidence).alias("var"))
    return df.join(cut, by).groupBy(by, "var").agg(F.coalesce(F.avg(F.when(F.col(r) <= F.col("var"), F.col(r))), F.first("var")).alias("cvar"))


def moments(r: str = "r") -> list[Column]:
    return [F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.avg(F.pow(F.col(r), 3)).alias("m3"), F.avg(F.pow(F.col(r), 2)).alias("m2"), F.kurtosis(r).alias("kurtosis")]


def risk_row(returns: DataFrame, by: str = "portfolio", ts: str = "day", r: str = "r", value: str = "value", risk_free: float = 0.02) -> DataFrame:
    """One wide row per key: VaR, CVaR, volatility, downside volatility, Sharpe, Sortino, moments, returns, drawdown, Calmar."""
    cut = expected_shortfall(returns, by, r, 0.95).join(expected_shortfall(returns, by, r, 0.99).withColumnsRenamed({"var": "var_99", "cvar": "cvar_99"}), by)
    daily = risk_free / YEAR
    excess = F.col(r) - F.lit(daily)
    base = returns.groupBy(by).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        F.stddev_pop(F.when(F.col(r) < 0, F.col(r))).alias("down"),
        F.stddev_pop(F.when(excess < 0, excess)).alias("down_excess"),
        F.avg(excess).alias("excess"),
        F.skewness(r).alias("skewness"),
        F.kurtosis(r).alias("kurtosis"),
        F.sum(F.log1p(r)).alias("log_growth"),
    )
    worst = drawdowns(returns, by, ts, value).groupBy(by).agg(F.max("drawdown").alias("max_drawdown"), F.max("duration").cast("long").alias("max_duration"))
    year = F.lit(YEAR)
    d = base.join(cut, by).join(worst, by)
    d = d.withColumn("annual_return", F.exp(F.col("log_growth") * year / F.col("n")) - 1)
    return d.select(
        by,
        "n",
        F.col("var").alias("var_95"),
        F.col("cvar").alias("cvar_95"),
        "var_99",
        "cvar_99",
        (F.col("std") * F.sqrt(year)).alias("volatility"),
        (F.coalesce("down", F.lit(0.0)) * F.sqrt(year)).alias("downside_volatility"),
        (F.exp("log_growth") - 1).alias("total_return"),
        F.round(F.log1p("annual_return"), 6).alias("log_annual_return"),
        F.coalesce(F.try_divide("excess", "std") * F.sqrt(year), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.try_divide("excess", "down_excess") * F.sqrt(year), F.lit(0.0)).alias("sortino"),
        "skewness",
        "kurtosis",
        "max_drawdown",
        "max_duration",
    )


def tail_ratio(r: str = "r") -> Column:
    return F.abs(F.coalesce(F.try_divide(F.percentile(r, 0.95), F.percentile(r, 0.05)), F.lit(0.0)))


def against_benchmark(returns: DataFrame, benchmark: DataFrame, by: str = "portfolio", ts: str = "day", r: str = "r", b: str = "b") -> DataFrame:
    """Beta, yearly alpha, correlation, tracking error and information ratio, aligned by date."""
    d = returns.join(benchmark.select(ts, b), ts)
    over = F.col(r) - F.col(b)
    g = d.groupBy(by).agg(F.regr_slope(r, b).alias("beta"), (F.regr_intercept(r, b) * YEAR).alias("alpha"), F.corr(r, b).alias("correlation"), F.stddev_pop(over).alias("te"), F.avg(over).alias("active"))
    return g.select(by, "beta", "alpha", "correlation", (F.col("te") * F.sqrt(F.lit(YEAR))).alias("tracking_error"), F.coalesce(F.try_divide("active", "te") * F.sqrt(F.lit(YEAR)), F.lit(0.0)).alias("information_ratio"))


def performance(snapshots: DataFrame, by: str = "portfolio", ts: str = "day", value: str = "value") -> DataFrame:
    """First to last: total return and its simple annualisation, volatility of returns, win share."""
    ends = snapshots.groupBy(by).agg(F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"))
    r = simple_returns(snapshots, by, ts, value).groupBy(by).agg(F.count("r").alias("n"), F.stddev_pop("r").alias("std"), F.avg((F.col("r") > 0).cast("double")).alias("win_share"))
    total = F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first")).otherwise(0.0)
    return ends.join(r, by).select(by, "n", total.alias("total_return"), (total * YEAR / F.col("n")).alias("annual_return"), (F.col("std") * F.sqrt(F.lit(YEAR))).alias("volatility"), "win_share")


def corrected_moments(df: DataFrame, by: str = "portfolio", r: str = "r") -> DataFrame:
    """Skewness and excess kurtosis with sample bias correction, and Sharpe on annualised figures."""
    g = df.groupBy(by).agg(F.count(r).cast("double").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("s"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    sharpe = F.try_divide(F.col("mean") * YEAR - F.lit(0.02), F.col("s") * F.sqrt(F.lit(YEAR)))
    return g.select(by, skew.alias("skew_sample"), kurt.alias("kurtosis_sample"), sharpe.alias("sharpe"))


def concentration(positions: DataFrame, by: str = "portfolio", key: str = "symbol", value: str = "market_value") -> DataFrame:
    """HHI, normalised HHI, largest weight and its key, top-5 and top-10 weight, effective number of holdings."""
    held = positions.groupBy(by, key).agg(F.sum(value).alias("_v"))
    w = held.withColumn("w", F.coalesce(F.try_divide("_v", F.sum("_v").over(Window.partitionBy(by))), F.lit(0.0)))
    w = w.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("w"), key)))
    g = w.groupBy(by).agg(
        F.count(key).alias("n"),
        F.sum(F.col("w") * F.col("w")).alias("hhi"),
        F.max("w").alias("max_weight"),
        F.min_by(key, "_k").alias("largest"),
        F.sum(F.when(F.col("_k") <= 5, F.col("w"))).alias("top5"),
        F.sum(F.when(F.col("_k") <= 10, F.col("w"))).alias("top10"),
    )
    one = F.try_divide(F.lit(1.0), F.col("n"))
    return g.withColumn("hhi_normalised", F.coalesce(F.try_divide(F.col("hhi") - one, 1 - one), F.lit(1.0))).withColumn("effective", F.try_divide(F.lit(1.0), F.col("hhi")))


def exposure(positions: DataFrame, by: str = "portfolio", group: str = "sector", value: str = "market_value") -> DataFrame:
    """Weight of each group, "Unknown" where it is missing."""
    g = positions.groupBy(by, F.coalesce(group, F.lit("Unknown")).alias(group)).agg(F.sum(value).alias("value"))
    return g.withColumn("weight", F.coalesce(F.try_divide("value", F.sum("value").over(Window.partitionBy(by))), F.lit(0.0)))


def liquidity(positions: DataFrame, volumes: DataFrame, by: str = "portfolio", participation: float = 0.2) -> DataFrame:
    """Weighted average daily volume and days to liquidate at a share of it; volumes: (symbol, adv)."""
    d = positions.join(volumes, "symbol").withColumn("days", F.try_divide(F.col("quantity"), F.col("adv") * participation))
    return d.groupBy(by).agg(F.try_divide(F.sum(F.col("market_value") * F.col("adv")), F.sum("market_value")).alias("weighted_adv"), F.max("days").alias("days_to_liquidate"), F.try_divide(F.sum(F.col("market_value") * F.col("days")), F.sum("market_value")).alias("weighted_days"))


def pairwise_correlation(returns: DataFrame, key: str = "portfolio", ts: str = "day", r: str = "r", method: str = "pearson") -> DataFrame:
    """(a, b, correlation) of each pair of keys over their common dates; spearman ranks first, ties by average rank."""
    d = returns.select(key, ts, F.col(r).alias("x"))
    if method == "spearman":
        w = Window.partitionBy(key)
        ties = F.count("x").over(Window.partitionBy(key, "x"))
        d = d.withColumn("x", F.rank().over(w.orderBy("x")) + (ties - 1) / 2.0)
    left, right = d.select(F.col(key).alias("a"), ts, F.col("x").alias("xa")), d.select(F.col(key).alias("b"), ts, F.col("x").alias("xb"))
    return left.join(right, ts).where("a < b").groupBy("a", "b").agg(F.corr("xa", "xb").alias("correlation"), F.covar_samp("xa", "xb").alias("covariance"), F.count(F.lit(1)).alias("n"))


def kendall(returns: DataFrame, key: str = "portfolio", ts: str = "day", r: str = "r") -> DataFrame:
    """Kendall's tau-b per pair of keys: concordance of all pairs of common dates (few dates per pair)."""
    d = returns.select(key, ts, F.col(r).alias("x"))
    both = d.select(F.col(key).alias("a"), ts, F.col("x").alias("xa")).join(d.select(F.col(key).alias("b"), ts, F.col("x").alias("xb")), ts).where("a < b")
    other = both.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col(ts).alias("t2"), F.col("xa").alias("ya"), F.col("xb").alias("yb"))
    pairs = both.join(other, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col(ts) < F.col("t2")))
    sa, sb = F.signum(F.col("xa") - F.col("ya")), F.signum(F.col("xb") - F.col("yb"))
    g = pairs.groupBy("a", "b").agg(F.sum(sa * sb).alias("s"), F.sum(F.abs(sa)).alias("na"), F.sum(F.abs(sb)).alias("nb"))
    return g.select("a", "b", F.try_divide("s", F.sqrt(F.col("na") * F.col("nb"))).alias("tau"))


def covariance_decomposition(returns: DataFrame, weights: DataFrame, key: str = "symbol", ts: str = "day", r: str = "r", z: float = 1.6448536269514722) -> DataFrame:
    """Marginal and component risk of each key from the sample covariance: mcr = (cov w) / sigma, ccr = w mcr; weights: (key, w)."""
    d = returns.select(key, ts, F.col(r).alias("x"))
    cov = d.select(F.col(key).alias("i"), ts, F.col("x").alias("xi")).join(d.select(F.col(key).alias("j"), ts, F.col("x").alias("xj")), ts).groupBy("i", "j").agg(F.covar_samp("xi", "xj").alias("cov"))
    wi, wj = weights.select(F.col(key).alias("i"), F.col("w").alias("wi")), weights.select(F.col(key).alias("j"), F.col("w").alias("wj"))
    row = cov.join(wj, "j").groupBy("i").agg(F.sum(F.col("cov") * F.col("wj")).alias("cw")).join(wi, "i")
    row = row.withColumn("sigma", F.sqrt(F.sum(F.col("wi") * F.col("cw")).over(Window.partitionBy(F.lit(0)))))
    return row.select(F.col("i").alias(key), F.col("wi").alias("w"), (F.col("cw") / F.col("sigma")).alias("mcr"), (F.col("wi") * F.col("cw") / F.col("sigma")).alias("ccr"), (F.col("wi") * F.col("cw") / F.pow("sigma", 2)).alias("share"), (F.col("sigma") * z).alias("portfolio_var"))


def scenarios(positions: DataFrame, shocks: DataFrame, by: str = "portfolio", value: str = "market_value") -> DataFrame:
    """Loss of each portfolio under each scenario; shocks: (scenario, sector or null for all, shock), a small table by design."""
    d = positions.groupBy(by, "sector").agg(F.sum(value).alias("v"))
    hit = shocks.where("sector is not null").select("scenario", "sector", F.col("shock").alias("own"))
    every = shocks.groupBy("scenario").agg(F.max(F.when(F.col("sector").isNull(), F.col("shock"))).alias("general"))
    grid = d.join(F.broadcast(every)).join(F.broadcast(hit), ["scenario", "sector"], "left")
    return grid.groupBy(by, "scenario").agg(F.sum(F.col("v") * F.coalesce("own", "general", F.lit(0.0))).alias("pnl"), F.sum("v").alias("value")).withColumn("pnl_share", F.try_divide("pnl", "value"))


def rank_transform(df: DataFrame, by: str, value: str) -> DataFrame:
    """Pseudo-observations: ordinal rank over n + 1."""
    w = Window.partitionBy(by)
    return df.withColumn("u", F.row_number().over(w.orderBy(value, *[c for c in df.columns if c not in (by, value)])) / (F.count(F.lit(1)).over(w) + 1.0))


def tail_dependence(family: str, theta: Column) -> tuple[Column, Column]:
    """Lower and upper tail dependence of Archimedean copulas by their published closed forms."""
    zero = F.lit(0.0)
    if family == "clayton":
        return F.when(theta > 0, F.pow(F.lit(2.0), -1 / theta)).otherwise(0.0), zero
    if family == "gumbel":
        return zero, 2 - F.pow(F.lit(2.0), 1 / theta)
    if family == "joe":
        return zero, 2 - F.pow(F.lit(2.0), 1 / theta)
    return zero, zero  # frank, gaussian


def kendall_to_parameter(family: str, tau: Column) -> Column:
    """The copula parameter that a Kendall's tau implies."""
    if family == "clayton":
        return 2 * tau / (1 - tau)
    if family == "gumbel":
        return 1 / (1 - tau)
    if family == "gaussian":
        return F.sin(F.lit(3.141592653589793 / 2) * tau)
    raise ValueError(family)


def budget_breaches(risk: DataFrame, budgets: DataFrame, by: str = "portfolio") -> DataFrame:
    """violation above 1.1 of a budget, warning above 0.9; budgets: (by, metric, budget), risk: (by, metric, value)."""
    d = risk.join(budgets, [by, "metric"])
    return d.withColumn("status", F.when(F.col("value") > F.col("budget") * 1.1, "violation").when(F.col("value") > F.col("budget") * 0.9, "warning").otherwise("ok"))
