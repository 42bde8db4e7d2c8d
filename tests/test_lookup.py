"""Lookup queries against their SQL, and edge cases of the lookups."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.operators import alerts, lookup
from orrery.plans import lookup_queries, registry

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in registry.QUERIES.items() if f.__module__ == lookup_queries.__name__]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df, q = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(q.columns)
    at = [q.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in q.fetchall())


def test_hierarchy_with_a_cycle_ends(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in lookup.hierarchy(links).collect()}
    assert got[("a", "b")] == 1 and got[("a", "c")] == 2 and got[("a", "a")] == 3 and len(got) == 9


def test_alias_order_and_nulls(spark):
    d = spark.createDataFrame([("Small ring",), ("none",), (None,)], "m string")
    assert [r[0] for r in d.select(lookup.alias_of(F.col("m"), [("small", "S"), ("ring", "R")])).collect()] == ["S", None, None]


def test_rules_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(alerts, "RULES_AT_ONCE", 1)
    rules = spark.createDataFrame([(1, "AND", [("price_above", 1.0, None)]), (2, "OR", [("price_above", 9.0, None), ("price_below", 3.0, "x")]), (3, "AND", [("price_above", 1.0, "y")])], "rule_id int, combine string, conditions array<struct<type:string,threshold:double,symbol:string>>")
    columns = "price last change_pct volume avg_volume fast slow prev_fast prev_slow rsi bb_upper bb_lower sentiment surprise".split()
    market = spark.createDataFrame([("x", 1, *[2.0] * 14), ("y", 1, *[4.0] * 14)], "symbol string, ts int, " + ", ".join(f"{c} double" for c in columns))
    got = {(r.rule_id, r.symbol): r.triggered for r in alerts.evaluate(rules, market).collect()}
    assert got == {(1, "x"): True, (1, "y"): True, (2, "x"): True, (2, "y"): False, (3, "y"): True}
