"""Queries of fitted models: copulas, ridge forecasts and the vector index. What is fitted is beyond SQL and held against
brute force in the tests; what goes into a fit, and what comes from it, has SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.operators import copula, forecast, indicators, risk, scoring, vector_index
from orrery.plans import views as v
from orrery.plans.registry import query


def _returns(spark, sf):
    return risk.simple_returns(v.snapshots(spark, sf)).select(F.col("portfolio").alias("symbol"), "day", "r")


@query(f"WITH {v.RETURNS} SELECT portfolio AS symbol, CAST(day AS VARCHAR) AS day, round(row_number() OVER (PARTITION BY portfolio ORDER BY r, day) / (count(*) OVER (PARTITION BY portfolio) + 1.0e0), 9) AS u FROM returns")
def pseudo_observations(spark, sf):
    return v.rounded(copula.pseudo_observations(_returns(spark, sf)).select("symbol", "day", "u"), 9)


@query()
def copula_fits(spark, sf):
    return v.rounded(copula.fit_pairs(copula.pseudo_observations(_returns(spark, sf))), 4)


@query()
def copula_choice(spark, sf):
    return v.rounded(copula.best(copula.fit_pairs(copula.pseudo_observations(_returns(spark, sf)))), 4)


_NAMES = ["lag_0", "lag_1", "lag_2", "mean_5", "mean_20", "std_20", "momentum_5", "rsi", "macd", "weekday", "month"]


def _rows(spark, sf):
    bars = v.bars(spark, sf)
    known = indicators.features(bars).select("symbol", "day", "lag_1", "lag_2", "mean_5", "mean_20", "std_20", "momentum_5", "weekday", "month")
    more = indicators.technical(bars).select("symbol", "day", F.col("rsi_14").alias("rsi"), "macd")
    d = bars.join(known, ["symbol", "day"]).join(more, ["symbol", "day"])
    return forecast.price_rows(d, [F.col("close") if n == "lag_0" else F.col(n) for n in _NAMES], _NAMES)


@query()
def ridge_models(spark, sf):
    m = forecast.fit_ridge(_rows(spark, sf))
    return v.rounded(m.withColumn("weights", F.transform("weights", lambda x: F.round(x, 6))), 6)


@query()
def ridge_backtest(spark, sf):
    done = forecast.backtest(_rows(spark, sf), F.col("order") < F.lit("2000-01-01").cast("date"))
    return v.rounded(scoring.forecast_errors(done, "series", "y", "predicted", "before"))


@query()
def ann_topk(spark, sf):
    """Ten nearest vectors by the inverted-file index; tests hold its recall against cosine_topk."""
    store = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    c = vector_index.centres(store, 24)
    index = vector_index.open_index(spark, vector_index.build(store, c, f"vectors-{uuid.uuid4().hex}"))
    asked = store.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return v.rounded(vector_index.probe(index, c, asked, 10, vector_index.probes_for(index, c, asked)))
