"""Fitted models: planted copula parameters, ridge against a direct solution, recall of the vector index."""

from math import sqrt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import copula, forecast, retrieval, vector_index

N = 3000


def planted(family, rnd):
    """Pairs of uniforms of a known copula."""
    if family in ("gaussian", "student_t"):
        x = rnd.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], N)
        return x / np.sqrt(rnd.chisquare(4, N) / 4)[:, None] if family == "student_t" else x
    u, w = rnd.uniform(size=N), rnd.uniform(size=N)
    if family == "clayton":  # by the conditional distribution
        return np.column_stack([u, ((w ** (-2 / 3) - 1) * u**-2.0 + 1) ** (-1 / 2)])
    if family == "frank":
        a = np.exp(-5 * u)
        return np.column_stack([u, -np.log1p(w * np.expm1(-5) / (w + (1 - w) * a)) / 5])
    t = 2.0  # gumbel: a stable variable of index 1 / t mixes two exponentials
    s, e = rnd.uniform(1e-9, np.pi, N), rnd.exponential(size=N)
    v = np.sin(s / t) / np.sin(s) ** t * (np.sin((1 - 1 / t) * s) / e) ** (t - 1)
    return np.exp(-((rnd.exponential(size=(N, 2)) / v[:, None]) ** (1 / t)))


def ranks(x):
    return (np.argsort(np.argsort(x)) + 1) / (len(x) + 1)


@pytest.mark.parametrize("family, want, within", [("gaussian", 0.6, 0.05), ("student_t", 0.6, 0.05), ("clayton", 2.0, 0.25), ("frank", 5.0, 0.5), ("gumbel", 2.0, 0.15)])
def test_planted_parameters_and_choice(family, want, within):
    x = planted(family, np.random.default_rng(11))
    fits = {name: (at, free, ll, 2 * k - 2 * ll) for name, at, free, ll, k in copula.fit(ranks(x[:, 0]), ranks(x[:, 1]))}
    assert len(fits) == 6 and fits[family][0] == pytest.approx(want, abs=within)
    assert min(fits, key=lambda f: fits[f][3]) == family
    if family == "student_t":
        assert 3 <= fits[family][1] <= 6


def test_densities_integrate_to_one():
    g = (np.arange(400) + 0.5) / 400
    u, v = (a.ravel() for a in np.meshgrid(g, g))
    for f, t in ((copula.clayton, 1.5), (copula.gumbel, 1.7), (copula.frank, 4.0), (copula.frank, -4.0), (copula.joe, 1.8)):
        assert np.exp(f(u, v, t)).mean() == pytest.approx(1, abs=0.02)
    x, y = (copula.student_quantile(w, 4) for w in (u, v))
    assert np.exp(copula.student(x, y, 0.5, 4)).mean() == pytest.approx(1, abs=0.02)


def test_pairs_of_series(spark):
    x = planted("clayton", np.random.default_rng(3))[:400]
    rows = [(s, i, float(x[i, k])) for i in range(400) for k, s in enumerate("ab")] + [("c", i, float(i)) for i in range(5)]
    seen = copula.pseudo_observations(spark.createDataFrame(rows, "symbol string, day int, r double"))
    got = copula.best(copula.fit_pairs(seen)).collect()
    assert [(r.a, r.b, r.n, r.family) for r in got] == [("a", "b", 400, "clayton")]  # pairs of too few days are left out
    assert copula.fit_pairs(seen.where("false")).collect() == []


def direct(x, y, penalty):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale > 0, scale, 1)
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean())) / np.where(scale > 0, scale, 1)
    return np.concatenate([[y.mean() - mean @ w], w])


def test_ridge_equals_a_direct_solution(spark):
    rnd = np.random.default_rng(5)
    frames = []
    for s, n in (("p", 300), ("q", 40), ("short", 4)):
        x = rnd.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 0, 1]
        frames.append(pd.DataFrame({"series": s, "order": range(n), "y": x @ [2.0, -0.3, 4.0] + rnd.normal(size=n), "x": [[float(v) for v in r] + [7.0] for r in x]}))
    data = pd.concat(frames)
    rows = spark.createDataFrame(data, "series string, order int, y double, x array<double>")
    odd = spark.createDataFrame([("p", 900, None, [1.0, 1.0, 1.0, 7.0]), ("p", 901, 1.0, [None, 1.0, 1.0, 7.0])], rows.schema)
    got = {r.series: r for r in forecast.fit_ridge(rows.unionByName(odd)).collect()}
    assert set(got) == {"p", "q"}
    folds = {(r.series, r.order): r.f for r in rows.select("series", "order", F.pmod(F.xxhash64("order"), F.lit(forecast.FOLDS)).alias("f")).collect()}
    for s in "pq":
        d = data[data["series"] == s]
        x, y = np.array(d["x"].tolist())[:, :3], d["y"].to_numpy()
        fold = np.array([folds[s, o] for o in d["order"]])
        errors = []
        for p in forecast.PENALTIES:
            errors.append(sum(((y[fold == k] - direct(x[fold != k], y[fold != k], p) @ np.column_stack([np.ones((fold == k).sum()), x[fold == k]]).T) ** 2).sum() for k in range(forecast.FOLDS)))
        k = int(np.argmin(errors))
        assert got[s].penalty == pytest.approx(forecast.PENALTIES[k]) and got[s].rmse == pytest.approx(sqrt(errors[k] / len(y)), rel=1e-6)
        assert [got[s].intercept, *got[s].weights] == pytest.approx([*direct(x, y, forecast.PENALTIES[k]), 0.0], rel=1e-6, abs=1e-8)


def test_index_recall_and_exactness(spark):
    store = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = store.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    c = vector_index.centres(store, 12)
    index = vector_index.open_index(spark, vector_index.build(store, c, "test-index"))
    assert index.count() == store.count()
    exact = retrieval.search(store, asked, 10)
    held = asked.where("query_id % 40 = 0")
    probes = vector_index.probes_for(index, c, held, 10, 0.95)
    assert vector_index.recall(vector_index.probe(index, c, asked, 10, probes), exact) >= 0.9
    full = {(r.query_id, r.rank, r.id) for r in vector_index.probe(index, c, asked, 10, len(c)).collect()}
    assert full == {(r.query_id, r.rank, r.id) for r in exact.collect()}


def test_search_equals_scores_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(retrieval, "CELLS", 64, raising=False)
    vectors = [[float(x) for x in v] for v in rng.integers(-3, 4, (150, 4))] + [None, [], [0.0] * 4, [1.0, None, 2.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0]]
    store = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").repartition(3)
    asked = store.where("id % 10 = 0 or id >= 150").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    every = store.crossJoin(asked).select("query_id", "id", retrieval.cosine(F.col("v"), F.col("q")).alias("score"))
    for k, least in ((7, -1.0), (20, 0.0)):
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        want = every.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        got = retrieval.search(store, asked, k, least)
        assert [str(tuple(r)) for r in got.orderBy("query_id", "rank").collect()] == [str(tuple(r)) for r in want.orderBy("query_id", "rank").collect()]
    # Pairs are scored as products of matrices, not one by one in a nested loop.
    assert "NestedLoopJoin" not in retrieval.search(store, asked, 3)._jdf.queryExecution().toString()
