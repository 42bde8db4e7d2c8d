"""Ridge forecasts of many series: moments per series and fold in one aggregate, penalties solved from them.

Rows are (series, order, y, x: array of features). The products of all pairs of (1, x, y) are summed per series and fold, with
partial sums before the shuffle, so a series of any length becomes FOLDS small matrices. For each fold and penalty the
coefficients come from the moments of the other folds, and the squared error on the fold from its own moments: no row is
read again. The penalty of least error is then solved on all folds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
PENALTIES = tuple(10.0 ** (-3 + 6 * k / 9) for k in range(10))
MODEL = "series string, n long, penalty double, rmse double, intercept double, weights array<double>"


def moments(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(series, fold, i, j, s) with i <= j: sums of products of (1, x..., y); rows with an absent value are left out."""
    z = F.concat(F.array(F.lit(1.0)), "x", F.array(F.col("y").cast("double")))
    d = rows.select("series", F.pmod(F.xxhash64("order"), F.lit(folds)).alias("fold"), z.alias("z")).where(F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v)))
    pairs = F.flatten(F.transform("z", lambda a, i: F.transform(F.filter(F.transform("z", lambda b, j: F.struct(i.alias("i"), j.alias("j"), (a * b).alias("p"))), lambda s: s["j"] >= s["i"]), lambda s: s)))
    return d.select("series", "fold", F.explode(pairs).alias("m")).groupBy("series", "fold", "m.i", "m.j").agg(F.sum("m.p").alias("s"))


def solve(m: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights of ridge on standardised features, from moments; features that don't vary get 0."""
    n, d = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:d] / n, 0))
    live = scale > 1e-9 * np.maximum(1e-300, np.abs(mean[:d]))
    w = np.zeros(d)
    if live.any():
        s = scale[live]
        a = cov[:d, :d][np.ix_(live, live)] / np.outer(s, s)
        w[live] = np.linalg.solve(a + penalty * np.eye(len(s)), cov[:d, d][live] / s) / s
    return np.concatenate([[mean[d] - w @ mean[:d]], w])


def squared_error(m: np.ndarray, beta: np.ndarray) -> float:
    """Sum of squared errors of coefficients over the rows behind the moments."""
    c = np.concatenate([-beta, [1.0]])
    return max(0.0, float(c @ m @ c))


def fit_ridge(rows: DataFrame, folds: int = FOLDS, penalties: tuple = PENALTIES, least: int = 10) -> DataFrame:
    """(series, n, penalty, rmse, intercept, weights): the penalty of least cross-validated error, of equals the smallest."""

    def of(g: pd.DataFrame) -> pd.DataFrame:
        size = int(g["j"].max()) + 1
        parts = np.zeros((folds, size, size))
        parts[g["fold"], g["i"], g["j"]] = g["s"]
        parts[g["fold"], g["j"], g["i"]] = g["s"]
        total = parts.sum(axis=0)
        n = int(round(total[0, 0]))
        held = [k for k in range(folds) if 0 < parts[k, 0, 0] < n]
        if n < least or not held:
            return pd.DataFrame(columns=["series", "n", "penalty", "rmse", "intercept", "weights"])
        errors = [sum(squared_error(parts[k], solve(total - parts[k], p)) for k in held) for p in penalties]
        k = int(np.argmin(errors))
        beta = solve(total, penalties[k])
        return pd.DataFrame({"series": [g["series"].iloc[0]], "n": [n], "penalty": [penalties[k]], "rmse": [float(np.sqrt(errors[k] / n))], "intercept": [beta[0]], "weights": [beta[1:]]})

    return moments(rows, folds).groupBy("series").applyInPandas(of, MODEL)


def predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with `predicted`, null where a feature is absent."""
    d = rows.join(models.select("series", "intercept", "weights"), "series")
    value = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    return d.withColumn("predicted", value).drop("intercept", "weights")


def price_rows(bars: DataFrame, features: list[Column], names: list[str], horizon: int = 1) -> DataFrame:
    """(series, order, before, y, x): the close `horizon` bars later is to be told from the features of a bar."""
    w = Window.partitionBy("symbol").orderBy("day")
    d = bars.select("symbol", "day", "close", *[f.alias(n) for f, n in zip(features, names)])
    return d.select(F.col("symbol").alias("series"), F.col("day").alias("order"), F.col("close").alias("before"), F.lead("close", horizon).over(w).alias("y"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"))


def backtest(rows: DataFrame, split: Column) -> DataFrame:
    """Models fitted on the rows before the split, and their predictions of the others: (series, order, before, y, predicted)."""
    models = fit_ridge(rows.where(split))
    return predict(rows.where(~split & F.col("y").isNotNull()), models).where("predicted is not null").select("series", "order", "before", "y", "predicted")
