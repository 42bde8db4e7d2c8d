"""Portfolio queries: line items as trades and fills, segments as portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import portfolio as pf
from orrery.operators import risk
from orrery.plans import views as v
from orrery.plans.registry import query


def _trades(spark, sf):
    l = v.table(spark, sf, "lineitem")  # noqa: E741
    day = F.col("l_shipdate").cast("date")
    g = l.groupBy("l_suppkey", day.alias("day"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side")).agg(v.total("l_quantity").alias("quantity"), v.total("l_extendedprice").alias("value"))
    return g.select("l_suppkey", F.struct("day", "side").alias("o"), "day", "side", "quantity", (F.col("value") / F.col("quantity")).alias("price"), F.lit(1.0).alias("commission"))


@query()
def position_accounting(spark, sf):
    d = pf.fold_positions(_trades(spark, sf), ["l_suppkey"], "o")
    return d.select("l_suppkey", "quantity", F.round("avg_cost", 4).alias("avg_cost"), F.round("realized", 2).alias("realized"))


@query("""WITH f AS (SELECT o_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS x, max(o_totalprice) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
w AS (SELECT o_orderkey, l_linenumber, sum(q) OVER o AS filled, CAST(sum(CAST(x AS DECIMAL(28,4))) OVER o AS DOUBLE) / sum(q) OVER o AS avg_price FROM f WINDOW o AS (PARTITION BY o_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, l_linenumber, filled, avg_price, CASE WHEN filled >= 100 THEN 'FILLED' WHEN filled > 0 THEN 'PARTIAL' ELSE 'OPEN' END AS status FROM w""")
def order_fills(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey")
    g = v.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "l_linenumber").agg(v.total("l_quantity").alias("quantity"), v.total("l_extendedprice").alias("x"))
    d = g.withColumn("price", F.col("x") / F.col("quantity")).withColumn("ordered", F.lit(100.0))
    return pf.fills(d, "o_orderkey", "l_linenumber").select("o_orderkey", "l_linenumber", "filled", "avg_price", "status")


@query(f"""WITH {v.POSITIONS}, p AS (SELECT portfolio, symbol, sum(market_value) AS mv FROM positions GROUP BY 1, 2), t AS (SELECT *, sum(mv) OVER (PARTITION BY portfolio) AS total FROM p) SELECT portfolio, symbol, round(total * 0.04e0 - mv, 2) AS trade FROM t WHERE abs(total * 0.04e0 - mv) > 0.01e0 * total""")
def rebalance_trades(spark, sf):
    p = v.positions(spark, sf).groupBy("portfolio", "symbol").agg(F.sum("market_value").alias("market_value"))
    targets = p.select("symbol").distinct().withColumn("target", F.lit(0.04))
    return pf.rebalance(p, targets).select("portfolio", "symbol", F.round("trade", 2).alias("trade"))


@query(f"""WITH {v.RETURNS}, {v.MARKET} SELECT portfolio, count(*) AS n, round(regr_intercept(r, b) * 252, 4) AS alpha, round(regr_r2(r, b), 6) AS r2, round(regr_slope(r, b), 6) AS beta_market FROM returns JOIN market USING (day) GROUP BY 1""")
def factor_regression(spark, sf):
    m = risk.simple_returns(v.benchmark_returns(spark, sf).withColumn("portfolio", F.lit("all")), name="market").select("day", "market")
    d = pf.factor_model(risk.simple_returns(v.snapshots(spark, sf)).join(m, "day"), ["market"], "portfolio")
    return d.select("portfolio", "n", F.round("alpha", 4).alias("alpha"), F.round("r2", 6).alias("r2"), F.round("beta_market", 6).alias("beta_market"))


def _assets(spark, sf) -> tuple[pd.DataFrame, np.ndarray]:
    """Each portfolio as an asset: its share of all last values, yearly mean and deviation of its returns; their correlations.

    One row an asset and one a pair of assets reach the driver, which needs the matrix to draw from.
    """
    r = risk.simple_returns(v.snapshots(spark, sf))
    known = r.groupBy("portfolio").agg(F.max_by("value", "day").alias("last"), (F.avg("r") * 12).alias("mu"), (F.stddev_pop("r") * 12**0.5).alias("sigma")).orderBy("portfolio").toPandas()
    known["weight"] = known["last"] / known["last"].sum()
    at = {p: k for k, p in enumerate(known["portfolio"])}
    matrix = np.eye(len(at))
    for x in risk.pairwise_correlation(r).select("a", "b", "correlation").collect():
        matrix[at[x.a], at[x.b]] = matrix[at[x.b], at[x.a]] = x.correlation
    return known.rename(columns={"portfolio": "symbol"})[["symbol", "weight", "mu", "sigma"]], matrix


@query()
def monte_carlo(spark, sf):
    return v.rounded(pf.simulation_summary(pf.monte_carlo(spark, *_assets(spark, sf), 4000, 21)))


@query()
def stress_tests(spark, sf):
    return v.rounded(pf.stress(spark, *_assets(spark, sf), {"crash": (-0.2, 2.0), "calm": (0.0, 0.5), "rate_shock": (-0.05, 1.3)}, 1000))


@query(f"""WITH {v.RETURNS}, w AS (SELECT *, value / lag(value, 3) OVER o - 1 AS momentum, stddev_pop(r) OVER (PARTITION BY portfolio ORDER BY day ROWS 5 PRECEDING) / nullif(stddev_pop(r) OVER (PARTITION BY portfolio ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS vr, 1 - value / max(value) OVER (PARTITION BY portfolio ORDER BY day ROWS UNBOUNDED PRECEDING) AS dd FROM returns WINDOW o AS (PARTITION BY portfolio ORDER BY day)),
x AS (SELECT portfolio, day, greatest(momentum, 0) + greatest(1 - vr, 0) / 2 AS bull, greatest(-momentum, 0) + dd AS bear, greatest(vr - 1, 0) AS wild, dd * greatest(vr - 1, 0) AS crisis, greatest(1 - vr, 0) / 2 + 0.1e0 AS side FROM w WHERE momentum IS NOT NULL AND vr IS NOT NULL), t AS (SELECT *, bull + bear + wild + crisis + side AS s FROM x)
SELECT portfolio, CAST(day AS VARCHAR) AS day, round(bull / s, 6) AS p_bull, round(bear / s, 6) AS p_bear, round(wild / s, 6) AS p_high_volatility FROM t""")
def regime_probabilities(spark, sf):
    w = Window.partitionBy("portfolio").orderBy("day")
    every = w.rowsBetween(Window.unboundedPreceding, 0)
    r = risk.simple_returns(v.snapshots(spark, sf))
    f = r.select("portfolio", "day", (F.col("value") / F.lag("value", 3).over(w) - 1).alias("momentum"), F.try_divide(F.stddev_pop("r").over(w.rowsBetween(-5, 0)), F.stddev_pop("r").over(every)).alias("vol_ratio"), (1 - F.col("value") / F.max("value").over(every)).alias("drawdown"))
    return v.rounded(pf.regime_scores(f.where("momentum is not null and vol_ratio is not null")).select("portfolio", "day", "p_bull", "p_bear", "p_high_volatility"))
