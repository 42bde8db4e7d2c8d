"""Portfolio accounting, rebalancing, factor models and simulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_positions(trades: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, quantity, avg_cost, realized): trades (side, quantity, price, commission) folded in order, average cost.

    Opening or adding moves the average cost, commission included; reducing, covering or flipping realises profit less
    commission. Closed positions (quantity 0) are left out.
    """
    t = F.struct(F.col(order).alias("o"), F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).alias("q"), F.col("price").alias("p"), F.col("commission").alias("c"))
    rows = trades.groupBy(*by).agg(F.array_sort(F.collect_list(t)).alias("t"))
    fold = F.expr("""aggregate(t, named_struct('q', 0D, 'a', 0D, 'r', 0D), (s, x) -> case
        when s.q = 0 or signum(s.q) = signum(x.q) then named_struct('q', s.q + x.q, 'a', (abs(s.q) * s.a + abs(x.q) * x.p + x.c) / (abs(s.q) + abs(x.q)), 'r', s.r)
        when abs(x.q) <= abs(s.q) then named_struct('q', s.q + x.q, 'a', if(s.q + x.q = 0, 0D, s.a), 'r', s.r + abs(x.q) * (x.p - s.a) * signum(s.q) - x.c)
        else named_struct('q', s.q + x.q, 'a', x.p, 'r', s.r + abs(s.q) * (x.p - s.a) * signum(s.q) - x.c) end)""")
    return rows.withColumn("s", fold).select(*by, F.col("s.q").alias("quantity"), F.col("s.a").alias("avg_cost"), F.col("s.r").alias("realized"))


def fills(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Running filled quantity, quantity-weighted price and status of each order's fills."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("filled", F.sum("quantity").over(w)).withColumn("avg_price", F.sum((F.col("quantity") * F.col("price")).cast("decimal(28,4)")).over(w).cast("double") / F.sum("quantity").over(w))
    return d.withColumn("status", F.when(F.col("filled") >= F.col("ordered"), "FILLED").when(F.col("filled") > 0, "PARTIAL").otherwise("OPEN"))


def rebalance(positions: DataFrame, targets: DataFrame, by: str = "portfolio", tolerance: float = 0.01) -> DataFrame:
    """Trades (value) towards target weights where a position is off by more than a share of the portfolio's value."""
    total = F.sum("market_value").over(Window.partitionBy(by))
    d = positions.withColumn("total", total).join(targets, "symbol").withColumn("trade", F.col("total") * F.col("target") - F.col("market_value"))
    return d.where(F.abs("trade") > tolerance * F.col("total"))


def factor_model(returns: DataFrame, factors: list[str], by: str, y: str = "r") -> DataFrame:
    """OLS of y on factors with intercept per key: alpha x 252, betas, R2, adjusted R2, residual deviation.

    Only the moments X'X and X'y leave the rows (one aggregate); each key's small system is solved in Arrow batches.
    """
    x = ["1", *factors]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    m = [F.sum(col(a) * col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)] + [F.sum(col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(x)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(y).cast("double").alias("n")]
    k = len(x)
    out = f"{by} string, n long, alpha double, r2 double, adj_r2 double, residual double, " + ", ".join(f"beta_{f} double" for f in factors)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                xx = np.array([[r[f"xx_{i}_{j}"] for j in range(k)] for i in range(k)])
                xy = np.array([r[f"xy_{i}"] for i in range(k)])
                beta, n = np.linalg.lstsq(xx, xy, rcond=None)[0], r["n"]
                sse = r["yy"] - beta @ xy
                sst = r["yy"] - xy[0] ** 2 / n
                r2 = 1 - sse / sst if sst > 0 else 0.0
                rows.append((r[by], int(n), beta[0] * 252, r2, 1 - (1 - r2) * (n - 1) / (n - k) if n > k else r2, float(np.sqrt(max(sse, 0) / n)), *beta[1:]))
            yield pd.DataFrame(rows, columns=[by, "n", "alpha", "r2", "adj_r2", "residual", *[f"beta_{f}" for f in factors]])

    return returns.groupBy(by).agg(*m).mapInPandas(solve, out)


def monte_carlo(spark, assets: pd.DataFrame, correlation: np.ndarray, sims: int, steps: int, seed: int = 42, dt: float = 1 / 252, student_df: float | None = None, parts: int = 8) -> DataFrame:
    """(sim, value, max_drawdown): terminal values of correlated GBM paths of a weighted portfolio; antithetic pairs.

    assets: (symbol, weight, mu, sigma). Each pair of simulations has its own seed, so results don't depend on partitions.
    """
    lower = np.linalg.cholesky(correlation)
    w, mu, sigma = (assets[c].to_numpy(float) for c in ("weight", "mu", "sigma"))

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pair in b["id"]:
                rng = np.random.default_rng([seed, int(pair)])
                z = rng.standard_normal((steps, len(w))) @ lower.T
                if student_df:
                    z = z * np.sqrt((student_df - 2) / rng.chisquare(student_df, (steps, 1)))
                for k, sign in enumerate((1, -1)):
                    r = (mu - sigma**2 / 2) * dt + sigma * np.sqrt(dt) * sign * z
                    value = (w * np.exp(np.cumsum(r, axis=0))).sum(axis=1) / w.sum()
                    peak = np.maximum.accumulate(np.maximum(value, 1.0))
                    rows.append((2 * int(pair) + k, float(value[-1]), float((1 - value / peak).max())))
            yield pd.DataFrame(rows, columns=["sim", "value", "max_drawdown"])

    return spark.range(0, sims // 2, 1, parts).mapInPandas(paths, "sim long, value double, max_drawdown double")


def simulation_summary(paths: DataFrame) -> DataFrame:
    r = F.col("value") - 1
    return paths.agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("deviation"), F.percentile(r, 0.05).alias("var_95"), F.percentile(r, 0.01).alias("var_99"), F.avg((r < 0).cast("double")).alias("p_loss"), F.avg("max_drawdown").alias("mean_drawdown"), F.max("max_drawdown").alias("worst_drawdown"))


def stress(spark, assets: pd.DataFrame, correlation: np.ndarray, shocks: dict[str, tuple[float, float]], sims: int = 2000, steps: int = 21) -> DataFrame:
    """(scenario, loss statistics): each scenario shifts drift and multiplies volatility; scenarios are a small driver-side list."""
    out = None
    for name, (shift, factor) in shocks.items():
        shifted = assets.assign(mu=assets["mu"] + shift * 252 / steps, sigma=assets["sigma"] * factor)
        d = simulation_summary(monte_carlo(spark, shifted, correlation, sims, steps)).withColumn("scenario", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def regime_scores(features: DataFrame) -> DataFrame:
    """Adds the share of each market regime and the likeliest one, from momentum, volatility ratio and drawdown."""
    up, calm = F.greatest(F.col("momentum"), F.lit(0.0)), F.greatest(1 - F.col("vol_ratio"), F.lit(0.0))
    down, wild = F.greatest(-F.col("momentum"), F.lit(0.0)), F.greatest(F.col("vol_ratio") - 1, F.lit(0.0))
    raw = {"bull": up + calm / 2, "bear": down + F.col("drawdown"), "high_volatility": wild, "crisis": F.col("drawdown") * wild, "sideways": calm / 2 + 0.1}
    total = sum(raw.values(), F.lit(0.0))
    d = features.withColumns({f"p_{k}": x / total for k, x in raw.items()})
    best = F.greatest(*[F.col(f"p_{k}") for k in raw])
    return d.withColumn("regime", F.coalesce(*[F.when(F.col(f"p_{k}") == best, F.lit(k)) for k in raw]))
