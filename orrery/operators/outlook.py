"""Market regimes, portfolio risk outlook, signal rules and reverse stress, as columns and small roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conditions on the features trend, volatility (ratio to normal), momentum, breadth, correlation,
# yield_curve, credit and sentiment, with what each adds to a regime.
REGIMES = ["bull", "bear", "high_volatility", "crisis", "recovery", "sideways", "transition"]
NEUTRAL = {"trend": 0.0, "volatility": 1.0, "momentum": 0.0, "breadth": 0.0, "correlation": 0.3, "yield_curve": 0.0, "credit": 0.0, "sentiment": 0.0}
STATISTICAL = {
    "bull": [("trend > 0.02 AND volatility < 1.2", 0.4), ("momentum > 0.05", 0.2), ("breadth > 0.1", 0.2)],
    "bear": [("trend < -0.05", 0.4), ("volatility > 1.5", 0.3), ("momentum < -0.05", 0.2)],
    "high_volatility": [("volatility > 2.0", 0.5), ("correlation > 0.7", 0.3)],
    "crisis": [("volatility > 3.0", 0.5), ("correlation > 0.8", 0.3), ("sentiment < -0.5", 0.2)],
    "recovery": [("volatility < 1.5 AND momentum > 0.03 AND breadth > 0", 0.4)],
    "sideways": [("abs(trend) < 0.01 AND volatility < 1.2", 0.3)],
    "transition": [("abs(sign(trend) + sign(momentum)) <= 1 AND volatility > 1.0", 0.3)],
}
RULES = {
    "bull": [("trend > 0.03", 0.3), ("volatility < 0.8", 0.2), ("momentum > 0.05", 0.2), ("breadth > 0.15", 0.2), ("sentiment > 0.2", 0.1)],
    "bear": [("trend < -0.05", 0.3), ("volatility > 1.5", 0.2), ("momentum < -0.05", 0.2), ("credit > 1.0", 0.2), ("sentiment < -0.3", 0.1)],
    "high_volatility": [("volatility > 2.0", 0.4), ("correlation > 0.7", 0.3), ("abs(trend) < 0.02", 0.2)],
    "crisis": [("volatility > 3.0", 0.5), ("correlation > 0.8", 0.3), ("sentiment < -0.6", 0.2)],
    "recovery": [("volatility < 1.2", 0.2), ("momentum > 0.03", 0.3), ("breadth > 0", 0.2), ("yield_curve > 0", 0.2)],
    "sideways": [("abs(trend) < 0.01", 0.3), ("volatility < 1.1", 0.2), ("abs(momentum) < 0.01", 0.2)],
    "transition": [("volatility > 1.2", 0.2), ("correlation > 0.5", 0.2), ("abs(momentum) < 0.02", 0.2)],
}
LEANING = {"bull": [("trend > 0.02", 0.1)], "bear": [("trend < -0.02", 0.1)], "high_volatility": [("volatility > 2.0", 0.15)], "crisis": [("volatility > 2.0", 0.05)]}
SCORERS = [(STATISTICAL, 0.1, 0.3), (RULES, 0.0, 0.4), (LEANING, 1 / 7, 0.3)]


def score_sql(table: dict, base: float, regime: str) -> str:
    """What a table of conditions gives a regime, as an SQL expression."""
    return " + ".join([f"CAST({base!r} AS DOUBLE)", *[f"CASE WHEN {c} THEN CAST({w!r} AS DOUBLE) ELSE 0 END" for c, w in table.get(regime, [])]])


def regimes(features: DataFrame) -> DataFrame:
    """Adds p_<regime>, the blend of three scorers, each normalised to a sum of one, and the likeliest regime.

    Features that are absent or null are neutral; of equally likely regimes the first of REGIMES is taken.
    """
    shown = features.columns
    lacking = {k: F.coalesce(k, F.lit(x)) if k in shown else F.lit(x) for k, x in NEUTRAL.items()}
    d = features.select(F.struct("*").alias("row"), *[x.alias(k) for k, x in lacking.items()])
    d = d.select("row", *[F.expr(score_sql(t, base, r)).alias(f"s{i}_{r}") for i, (t, base, _) in enumerate(SCORERS) for r in REGIMES])
    d = d.select("*", *[sum((F.col(f"s{i}_{r}") for r in REGIMES), F.lit(0.0)).alias(f"total{i}") for i in range(len(SCORERS))])
    blend = lambda r: sum((w * F.coalesce(F.try_divide(F.col(f"s{i}_{r}"), F.col(f"total{i}")), F.lit(0.0)) for i, (_, _, w) in enumerate(SCORERS)), F.lit(0.0))
    d = d.select("row", *[blend(r).alias(f"b_{r}") for r in REGIMES])
    total = sum((F.col(f"b_{r}") for r in REGIMES), F.lit(0.0))
    d = d.select("row.*", *[(F.col(f"b_{r}") / total).alias(f"p_{r}") for r in REGIMES])
    best = F.greatest(*[F.round(f"p_{r}", 12) for r in REGIMES])
    return d.withColumn("regime", F.coalesce(*[F.when(F.round(f"p_{r}", 12) == best, F.lit(r)) for r in REGIMES]))


def risk_outlook(profile: DataFrame, by: str, days: int = 21) -> DataFrame:
    """(by, risk, probability, severity, expected_loss): eight heuristic scores of each portfolio.

    Profile columns: vol, drawdown, max_drawdown, kurtosis, skewness, sector_share, correlation, liquidity, days_to_sell,
    factor_exposure, hhi, max_weight, vix_ratio. A null takes the value of a middling portfolio.
    """
    middling = {"vol": 0.15, "drawdown": 0.0, "max_drawdown": 0.2, "kurtosis": 4.0, "skewness": -0.5, "sector_share": 0.3, "correlation": 0.3, "liquidity": 0.8, "days_to_sell": 5.0, "factor_exposure": 0.0, "hhi": 0.1, "max_weight": 0.1, "vix_ratio": 20 / 18}
    d = profile.select(by, *[F.coalesce(F.col(k).cast("double"), F.lit(x)).alias(k) for k, x in middling.items()])
    c, lit = F.col, F.lit
    clip = lambda x, low, high: F.least(F.greatest(x, lit(low)), lit(high))
    drawdown = clip(0.10 * F.least(lit(2.0), c("vol") / 0.15) * (1 + 2 * c("drawdown")) * F.sqrt(lit(days / 21)), 0.01, 0.80)
    tail = clip(0.01 * (c("kurtosis") / 3) * (1 + F.abs("skewness")), 0.001, 0.05)
    spike = F.when(c("vix_ratio") > 1.5, 0.3).when(c("vix_ratio") > 1.2, 0.15).otherwise(0.05)
    breakdown = F.least(0.1 * F.when(c("sector_share") > 0.4, 2.0).otherwise(1.0) * F.when(c("correlation") < 0.2, 1.5).otherwise(1.0), lit(0.3))
    illiquid = F.when(c("days_to_sell") > 10, 0.15).when(c("liquidity") < 0.5, 0.2).otherwise(0.05)
    crowding = F.least(lit(0.3), c("factor_exposure") / 2)
    held = F.greatest(F.when(c("hhi") > 0.25, 0.4).when(c("hhi") > 0.15, 0.2).otherwise(0.0), F.when(c("max_weight") > 0.20, 0.5).when(c("max_weight") > 0.15, 0.3).otherwise(0.0))
    deep = F.least(lit(0.5), 1.5 * c("max_drawdown"))
    jump = F.least(lit(0.6), 0.1 + c("max_drawdown"))
    # Kind, probability, severity, and what the probability is multiplied with for the loss.
    scores = [
        ("drawdown", drawdown, deep, deep),
        ("tail_event", tail, jump, jump),
        ("volatility_spike", spike, lit(0.3), lit(0.1)),
        ("correlation_breakdown", breakdown, lit(0.25), lit(0.15)),
        ("liquidity", illiquid, lit(0.4), lit(0.2)),
        ("factor_crowding", crowding, lit(0.2), lit(0.1)),
        ("concentration", held, lit(0.3), lit(0.15)),
        ("regime_shift", lit(0.15), lit(0.35), lit(1 / 3)),
    ]
    rows = F.array(*[F.struct(lit(k).alias("risk"), p.cast("double").alias("probability"), s.cast("double").alias("severity"), (p * x).cast("double").alias("expected_loss")) for k, p, s, x in scores])
    return d.select(by, F.explode(rows).alias("r")).select(by, "r.*")


def signals(facts: DataFrame, by: str) -> DataFrame:
    """(by, category, signal, strength) of every rule that a row of market and fundamental facts fires.

    Facts that are null fire nothing. Columns: days_until_earnings, pre_return, revisions_up, revisions_down, iv_rank,
    volume_ratio, gap_up, short_change, payout, coverage, upgrades, downgrades.
    """
    c, lit = F.col, F.lit
    # Category, signal, condition, strength.
    rules: list[tuple[str, str, Column, Column]] = [
        ("earnings", "imminent", c("days_until_earnings").between(0, 7), lit(0.9)),
        ("earnings", "upcoming", c("days_until_earnings").between(8, 30), lit(0.6)),
        ("earnings", "drift", F.abs("pre_return") > 0.05, F.least(F.abs("pre_return") * 10, lit(0.8))),
        ("earnings", "revisions", c("revisions_up") > 2 * c("revisions_down"), lit(0.7)),
        ("earnings", "implied_volatility", c("iv_rank") > 80, lit(0.6)),
        ("merger", "volume", c("volume_ratio") > 3, lit(0.7)),
        ("merger", "gap", c("gap_up") > 0.05, lit(0.8)),
        ("merger", "short_covering", c("short_change") < -0.2, lit(0.6)),
        ("dividend", "cut", c("payout") > 0.8, lit(0.7)),
        ("dividend", "coverage", c("coverage") > 2.0, lit(0.6)),
        ("analyst", "upgrades", c("upgrades") > 2 * c("downgrades"), F.least(lit(0.8), 0.4 + 0.1 * c("upgrades"))),
        ("analyst", "downgrades", c("downgrades") > 2 * c("upgrades"), F.least(lit(0.8), 0.4 + 0.1 * c("downgrades"))),
    ]
    fired = F.array(*[F.when(met, F.struct(lit(k).alias("category"), lit(s).alias("signal"), x.cast("double").alias("strength"))) for k, s, met, x in rules])
    return facts.select(by, F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("s")).select(by, "s.*")


def reverse_stress(positions: DataFrame, by: str, share: float, most: float = 1.0, steps: int = 256) -> DataFrame:
    """(by, severity, loss): the least severity of a shock at which a portfolio loses `share` of its value; null if none does.

    Positions have market_value and sensitivity (loss per unit of severity); a position loses no more than all it is
    worth. Losses grow with severity, so a grid of severities decides; each position is summed up before the shuffle.
    """
    grid = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: k * (most / steps))
    d = positions.select(by, "market_value", "sensitivity", F.explode(grid).alias("severity"))
    hit = F.least(F.col("sensitivity") * F.col("severity"), F.lit(1.0))
    losses = d.groupBy(by, "severity").agg(F.sum(F.col("market_value") * hit).alias("loss"), F.sum("market_value").alias("value"))
    met = F.when(F.col("loss") >= share * F.col("value") - 1e-9 * F.col("value"), F.struct("severity", "loss"))
    return losses.groupBy(by).agg(F.min(met).alias("m")).select(by, "m.severity", "m.loss")


def bootstrap_paths(returns: DataFrame, by: str, r: str, sims: int, steps: int, seed: int = 42) -> DataFrame:
    """(by, path, final, worst): seeded normal paths with each series' mean and deviation, their final growth and drawdown.

    Every path is one row and folds over its steps, so paths spread over tasks; series without a deviation stay flat.
    """
    moments = returns.groupBy(by).agg(F.avg(r).alias("mu"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sigma"))
    paths = moments.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    # Box-Muller on hashes of (series, path, step): the same draws however rows are dealt.
    unit = lambda salt: lambda k: (F.pmod(F.xxhash64(by, "path", k, F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    normal = lambda k: F.sqrt(-2 * F.log(unit("u")(k))) * F.cos(6.283185307179586 * unit("v")(k))
    state = lambda growth, peak, worst: F.struct(growth.alias("growth"), peak.alias("peak"), worst.alias("worst"))
    move = lambda s, k: _after(s["growth"] * (1 + F.col("mu") + F.col("sigma") * normal(k)), s)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(1.0), F.lit(1.0), F.lit(0.0)), move)
    return paths.select(by, "path", end.alias("e")).select(by, "path", F.col("e.growth").alias("final"), F.col("e.worst").alias("worst"))


def _after(growth: Column, s: Column) -> Column:
    # `transform` over an array of one binds the new growth, so that it is computed once.
    step = lambda g: F.struct(g.alias("growth"), F.greatest(s["peak"], g).alias("peak"), F.greatest(s["worst"], 1 - g / F.greatest(s["peak"], g)).alias("worst"))
    return F.transform(F.array(growth), step)[0]


def path_summary(paths: DataFrame, by: str) -> DataFrame:
    """(by, p5, p50, p95, gain, mean_drawdown) of simulated paths."""
    at = F.percentile("final", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return paths.groupBy(by).agg(at.alias("p"), F.avg((F.col("final") > 1).cast("double")).alias("gain"), F.avg("worst").alias("mean_drawdown")).select(by, F.col("p")[0].alias("p5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"), "gain", "mean_drawdown")
