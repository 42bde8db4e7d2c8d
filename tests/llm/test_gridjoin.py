"""The grid join against all pairs, with trees of several levels and groups that are close as a whole."""

import math

import numpy as np
import pytest

from orrery.llm import gridjoin

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = [(k, r) for k, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    near = {k: set() for k in range(len(rows))}
    for i, a in ok:
        for j, b in ok:
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float64(np.float32(a[1])), np.float64(np.float32(b[1]))
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine:
                    near[i].add(j), near[j].add(i)
    seen, out = {}, []
    for k in near:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j), todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= {j: min(ids, default=None) for j in group}
    for k, r in enumerate(rows):
        out.append((r[0], len(near[k]), seen[k], r[0] == seen[k]))
    return sorted(out, key=str)


def run(spark, rows, cosine=0.93):
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND + ", n string").repartition(3)
    return sorted((tuple(r) for r in gridjoin.near_vectors(df, cosine).collect()), key=str)


def cloud(seed, n, dim=8, spread=0.15):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, dim))
    return [(i, [float(x) for x in (centres[i % 4] + rnd.normal(size=dim) * (spread if i % 4 else 0.01))], int(i % 4 == 3)) for i in range(n)]


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of a few vectors and a tree of several levels, also in the workers, where the functions see the value at call."""
    monkeypatch.setattr(gridjoin, "BLOCK", 4)
    monkeypatch.setattr(gridjoin, "FAN", 1)


def test_all_pairs_by_a_deep_tree(spark, small_blocks):
    rows = cloud(1, 150)
    assert run(spark, rows) == brute(rows)


def test_plain_blocks_and_another_threshold(spark):
    rows = cloud(2, 120)
    assert run(spark, rows, 0.8) == brute(rows, 0.8)


def test_groups_close_as_a_whole_are_counted_without_pairs(spark, small_blocks, monkeypatch):
    rows = cloud(3, 200, spread=0.01)
    made = []
    spread = gridjoin._spread
    monkeypatch.setattr(gridjoin, "_spread", lambda stage, blocks, levels, close: made.append(close.where("level > 0").count()) or spread(stage, blocks, levels, close))
    assert run(spark, rows) == brute(rows) and made[0] > 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (12, [3e38, 3e38], 3), (13, [1e-38, 1e-38], 3), (14, [-0.0, 1.0], 4), (15, [0.0, 1.0], 4)]
    want = [(i, n, c, c is None or i == c) for i, n, c, _ in brute(rows)]
    assert run(spark, rows) == sorted(want, key=str)


def test_empty_table(spark):
    assert gridjoin.near_vectors(spark.createDataFrame([], KIND)).collect() == []


def test_one_of_each_group_stays(spark):
    rows = cloud(5, 60)
    df = spark.createDataFrame(rows, KIND)
    want = {r[0] for r in brute(rows) if r[3]}
    kept = gridjoin.keep_first(df)
    assert {r.vec_id for r in kept.collect()} == want and kept.columns == df.columns
