"""Copulas of pairs of return series by maximum likelihood, the best family by AIC.

Each series is turned into ranks over n + 1 by a window; pairs meet by an equi-join on the day, so a pair's rows are one
group, bounded by the length of the history. Within a group the log-likelihood of a family is a sum over numpy columns,
maximised by golden section over its one parameter (for Student's t once per degree of freedom of a fixed grid). The
densities are the published ones. Pairs are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import lgamma, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of freedom that are tried.
FREEDOM = (2.5, 3, 4, 5, 6, 8, 10, 13, 17, 22, 30)
FIT = "a string, b string, n long, family string, parameter double, freedom double, log_likelihood double, aic double, bic double"


def pseudo_observations(returns: DataFrame, by: str = "symbol", order: str = "day", value: str = "r") -> DataFrame:
    """Adds u: the rank of each value in its series over n + 1; equal values rank in order of time."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value, order))
    return returns.withColumn("u", rank / (F.count(F.lit(1)).over(Window.partitionBy(by)) + 1.0))


def gaussian(x: np.ndarray, y: np.ndarray, r: float) -> np.ndarray:
    d = 1 - r * r
    return -0.5 * log(d) - (r * r * (x * x + y * y) - 2 * r * x * y) / (2 * d)


def student(x: np.ndarray, y: np.ndarray, r: float, v: float) -> np.ndarray:
    d = 1 - r * r
    ends = (v + 1) / 2 * (np.log1p(x * x / v) + np.log1p(y * y / v))
    return lgamma(v / 2 + 1) + lgamma(v / 2) - 2 * lgamma((v + 1) / 2) - 0.5 * log(d) - (v + 2) / 2 * np.log1p((x * x - 2 * r * x * y + y * y) / (v * d)) + ends


def clayton(u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
    return log(1 + t) - (t + 1) * (np.log(u) + np.log(v)) - (2 + 1 / t) * np.log(u**-t + v**-t - 1)


def gumbel(u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
    a, b = -np.log(u), -np.log(v)
    s = np.logaddexp(t * np.log(a), t * np.log(b))
    return a + b - np.exp(s / t) + (t - 1) * (np.log(a) + np.log(b)) + (2 / t - 2) * s + np.log1p((t - 1) * np.exp(-s / t))


def frank(u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
    if abs(t) < 1e-6:
        return np.zeros_like(u)
    e = -np.expm1(-t)
    return np.log(t * e) - t * (u + v) - 2 * np.log(np.abs(e - np.expm1(-t * u) * np.expm1(-t * v)))


def joe(u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
    x, y = (1 - u) ** t, (1 - v) ** t
    m = x + y - x * y
    return (1 / t - 2) * np.log(m) + (t - 1) * (np.log1p(-u) + np.log1p(-v)) + np.log(t - 1 + m)


@lru_cache(maxsize=64)
def _student_table(v: float) -> tuple[np.ndarray, np.ndarray]:
    # With x = sqrt(v) tan(p) the density is proportional to cos(p)^(v - 1).
    p = np.linspace(-pi / 2, pi / 2, 200_001)
    mass = np.cos(p) ** (v - 1)
    total = np.concatenate([[0.0], np.cumsum((mass[1:] + mass[:-1]) / 2)])
    return total / total[-1], p


def student_quantile(u: np.ndarray, v: float) -> np.ndarray:
    share, p = _student_table(v)
    return sqrt(v) * np.tan(np.interp(u, share, p))


def golden(f: Callable[[float], float], low: float, high: float, steps: int = 60) -> tuple[float, float]:
    """The largest value of f on [low, high] near the best of a coarse grid, and where it is."""
    grid = np.linspace(low, high, 25)
    values = [f(g) for g in grid]
    k = int(np.nanargmax(values))
    a, b, g = grid[max(0, k - 1)], grid[min(24, k + 1)], (sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return max((fc, c), (fd, d), (values[k], float(grid[k])))


def fit(u: np.ndarray, v: np.ndarray) -> list[tuple]:
    """(family, parameter, freedom, log-likelihood, number of parameters) of all six families."""
    inv = NormalDist().inv_cdf
    zx, zy = (np.array([inv(t) for t in w]) for w in (u, v))
    total = lambda d: float(np.sum(d)) if np.all(np.isfinite(d)) else -1e300
    out = [("gaussian", *golden(lambda r: total(gaussian(zx, zy, r)), -0.99, 0.99), None, 1)]
    tries = []
    for free in FREEDOM:
        x, y = student_quantile(u, free), student_quantile(v, free)
        tries.append((*golden(lambda r: total(student(x, y, r, free)), -0.99, 0.99), float(free)))
    out.append(("student_t", *max(tries), 2))
    with np.errstate(all="ignore"):
        for name, f, low, high in (("clayton", clayton, log(0.01), log(50)), ("gumbel", gumbel, log(0.01), log(49)), ("joe", joe, log(0.01), log(49))):
            # On a log scale; gumbel and joe start at 1.
            base = 0.0 if name == "clayton" else 1.0
            ll, at = golden(lambda s: total(f(u, v, base + float(np.exp(s)))), low, high)
            out.append((name, ll, base + float(np.exp(at)), None, 1))
        out.append(("frank", *golden(lambda t: total(frank(u, v, t)), -50, 50), None, 1))
    return [(name, at, free, ll, k) for name, ll, at, free, k in out]


def fit_pairs(observed: DataFrame, by: str = "symbol", order: str = "day", least: int = 20) -> DataFrame:
    """All families of all pairs (a < b) of series with `least` days in common or more. observed: (symbol, day, u)."""
    left = observed.select(F.col(by).cast("string").alias("a"), order, F.col("u").alias("ua"))
    right = observed.select(F.col(by).cast("string").alias("b"), order, F.col("u").alias("ub"))

    def of(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < least:
            return pd.DataFrame(columns=[c.split()[0] for c in FIT.split(", ")])
        g = g.sort_values(order)
        n = len(g)
        rows = [(g["a"].iloc[0], g["b"].iloc[0], n, name, at, free, ll, 2 * k - 2 * ll, k * log(n) - 2 * ll) for name, at, free, ll, k in fit(g["ua"].to_numpy(), g["ub"].to_numpy())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")]).astype({"freedom": "float64"})

    return left.join(right, order).where("a < b").groupBy("a", "b").applyInPandas(of, FIT)


def best(fits: DataFrame) -> DataFrame:
    """The family of least AIC of each pair."""
    w = Window.partitionBy("a", "b").orderBy("aic", "family")
    return fits.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
