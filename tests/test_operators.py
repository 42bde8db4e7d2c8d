"""Operators on small fixtures with hand-computed results, and the registry's contract."""

import datetime as dt
import difflib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import alerts, graph, indicators, news, portfolio, retrieval, risk, scoring, store
from orrery.plans import graphs_queries, indicators_queries, scoring_queries, views

SF = "/root/testdata/sf0.001"


def series(spark, values, key="p"):
    rows = [(key, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "portfolio string, day date, value double")


def test_returns_skip_non_positive_predecessors(spark):
    got = [r.r for r in risk.simple_returns(series(spark, [100, 110, 0, 50, 100])).orderBy("day").collect()]
    assert got == pytest.approx([0.1, -1.0, 1.0])


def test_drawdown_counts_ties_and_the_first_row(spark):
    rows = risk.drawdowns(series(spark, [100, 100, 90, 120, 60, 120, 130])).orderBy("day").collect()
    assert [round(r.drawdown, 4) for r in rows] == [0, 0, 0.1, 0, 0.5, 0, 0]
    assert [r.duration for r in rows] == [1, 2, 3, 0, 1, 2, 0]


def test_monotone_series_has_no_drawdown(spark):
    s = risk.simple_returns(series(spark, range(9500, 10500, 100)))
    row = risk.risk_row(s).collect()[0]
    assert row.max_drawdown == 0 and row.total_return == pytest.approx(10400 / 9500 - 1)


def test_position_fold_opens_reduces_and_flips(spark):
    t = [(1, "BUY", 100.0, 150.0, 1.0), (2, "SELL", 50.0, 180.0, 1.0), (3, "SELL", 80.0, 170.0, 0.0)]
    df = spark.createDataFrame(t, "o int, side string, quantity double, price double, commission double").withColumn("symbol", F.lit("x"))
    first = portfolio.fold_positions(df.where("o = 1"), ["symbol"], "o").collect()[0]
    assert (first.quantity, first.avg_cost) == (100, 150.01)
    second = portfolio.fold_positions(df.where("o < 3"), ["symbol"], "o").collect()[0]
    assert (second.quantity, round(second.realized, 2)) == (50, 1498.5)
    last = portfolio.fold_positions(df, ["symbol"], "o").collect()[0]
    assert (last.quantity, last.avg_cost) == (-30, 170.0)


def bars(spark, closes, volumes=None):
    rows = [("s", dt.date(2023, 1, 1) + dt.timedelta(days=i), float(c) + 1.0, float(c) - 1.0, float(c), int((volumes or [1000] * len(closes))[i])) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double, volume long")


def test_golden_cross_after_a_turn(spark):
    closes = [300.0 - i * 0.5 for i in range(230)] + [185.0 + i * 2.0 for i in range(90)]
    got = indicators.crosses(bars(spark, closes)).collect()
    assert [r.direction for r in got] == ["golden_cross"] and got[0].confidence == "high"


def test_breakout_needs_volume(spark):
    closes = [100.0] * 50 + [130.0]
    assert indicators.breakouts(bars(spark, closes, [1000] * 50 + [9000])).count() == 1
    assert indicators.breakouts(bars(spark, closes)).count() == 0


def test_double_top(spark):
    up, down = list(np.linspace(100, 150, 25)), list(np.linspace(150, 120, 15))
    closes = up + down[1:] + list(np.linspace(120, 150, 15))[1:] + list(np.linspace(150, 100, 25))[1:]
    got = indicators.reversals(bars(spark, closes)).where("pattern = 'double_top'").collect()
    assert len(got) == 1 and got[0].peak_price == pytest.approx(151) and got[0].target_price < got[0].neck


def test_seasonality_finds_a_yearly_wave(spark):
    days = pd.date_range("2015-01-31", periods=60, freq="ME")
    rows = [("s", d.date(), 0.0, 0.0, float(100 + 10 * np.sin(2 * np.pi * i / 12)), 1) for i, d in enumerate(days)]
    b = spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double, volume long")
    assert indicators.seasonality(b).collect()[0].period == 12


def test_recursive_ema_equals_a_loop(spark):
    closes = [10.0, 12, 11, 15, 9]
    want, e = [], None
    for c in closes:
        e = c if e is None else 2 / 4 * c + (1 - 2 / 4) * e
        want.append(e)
    got = [r.ema for r in indicators.ema_recursive(bars(spark, closes), 3).orderBy("day").collect()]
    assert got == pytest.approx(want)


def test_ema_query_takes_all_bars(spark):
    got = indicators_queries.ema_full(spark, SF)
    bars = views.bars(spark, SF)
    assert got.count() == bars.count() and got.agg(F.min("day")).collect() == bars.agg(F.min("day").cast("string")).collect()


def test_event_probability_takes_all_users(spark, tmp_path):
    spark.createDataFrame([("a", 3, 100.0), ("a", 4, 300.0)], "event_type string, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    (r,) = scoring_queries.event_probability(spark, str(tmp_path)).collect()
    assert (r.probability, r.confidence) == pytest.approx((0.1 + 0.9 * 0.4 * 0.5, 0.3 + 0.4 * 0.4 + 0.3 * 0.4))


def test_events_are_found_beyond_2000_characters(spark):
    d = spark.createDataFrame([(1, "word " * 600 + "the merger was announced")], "article_id long, content string")
    assert [r.event for r in news.events(d).collect()] != []


def test_canonical_urls(spark):
    urls = ["https://www.Example.com/article/?utm_source=twitter&b=2&a=1#x", "https://example.com/article", "HTTP://a.b/?ref=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.c for r in df.select(news.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["https://example.com/article?a=1&b=2", "https://example.com/article", "http://a.b"]


def test_html_is_stripped(spark):
    html = "<html><script>x</script><style>y</style><!-- c --><p>Hello   <b>world</b> !</p></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(news.strip_html(F.col("h")).alias("t")).collect()[0].t == "Hello world!"


def test_title_ratio_and_freshness(spark):
    df = spark.createDataFrame([("Apple Reports Record Q3 Earnings Beating Estimates", "Apple Reports Record Q3 Earnings Beats Estimates", 12.0)], "a string, b string, h double")
    r = df.select(news.title_ratio("a", "b").alias("ratio"), news.freshness_exponential(F.col("h")).alias("e"), news.freshness_step(F.lit(None).cast("double")).alias("s")).collect()[0]
    assert r.ratio > 0.9 and r.e == pytest.approx(0.5) and r.s == 0.1


def test_similar_titles_equal_all_pairs(spark):
    titles = ["Apple reports record Q3 earnings beating all estimates", "Breaking Apple reports record Q3 earnings beating all estimates", "Aple reports record Q3 earnings beating all estimates", "Oil falls as demand weakens", "Oil falls as demand weakens", "Oils fall as demand weakens", "abc", "ab", "", "zebra crossing", None]
    rows = [(i, t, "", f"content {i}", f"http://x/{i}", "s") for i, t in enumerate(titles)]
    d = spark.createDataFrame(rows, "article_id long, title string, summary string, content string, url string, source string")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {(i, j): ratio(a, b) for i, a in enumerate(titles) for j, b in enumerate(titles) if i < j and a and b and ratio(a, b) >= 0.8}
    got = news.similar_titles(d).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.ratio for r in got} == pytest.approx(want) and {(0, 1), (0, 2), (4, 5)} <= set(want)
    found = {r.article_id: (r.reason, r.duplicate_of) for r in news.dedup(d).collect()}
    assert len(found) == len(rows) and {i: found[i] for i in (1, 2, 4, 5)} == {1: ("title_similarity", 0), 2: ("title_similarity", 0), 4: ("title_similarity", 3), 5: ("title_similarity", 3)}


def test_language_of_short_and_empty_texts(spark):
    df = spark.createDataFrame([("the cat and the dog",), ("el perro y la casa de los",), ("",), ("xyzzy",)], "t string")
    lang, conf = news.language(news.tokens(F.col("t")))
    got = [(r.l, round(r.c, 2)) for r in df.select(lang.alias("l"), conf.alias("c")).collect()]
    assert [g[0] for g in got] == ["en", "es", "en", "en"] and got[2][1] == 0.3 and got[3][1] == 0.4


def edges(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y")]
    return spark.createDataFrame([(s, d, "k") for s, d in e], "src string, dst string, kind string")


def test_graph_on_two_triangles_and_a_bridge(spark):
    e = edges(spark)
    comp = {r.id: r.component for r in graph.components(e).collect()}
    assert comp == {**dict.fromkeys("abcdef", "a"), "x": "x", "y": "x"}
    ranks = {r.id: r["rank"] for r in graph.pagerank(e, rounds=30).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) in "de"
    pairs = spark.createDataFrame([("a", "f"), ("f", "a")], "a string, b string")
    assert [(r.a, r.b, r.distance) for r in graph.shortest_paths(e, pairs).collect()] == [("a", "f", 5)]
    assert [r.path for r in graph.all_paths(e, pairs, 5).collect()] == [["a", "b", "c", "d", "e", "f"]]
    s = graph.statistics(e).collect()[0]
    assert (s.nodes, s.edges) == (8, 8) and s.density == pytest.approx(2 * 8 / 56)


def test_graph_queries_take_all_supply_edges(spark, tmp_path):
    tables = {"nation": ([(7, 3), (8, 2)], "n_nationkey long, n_regionkey long"), "supplier": ([(1, 7), (20, 8)], "s_suppkey long, s_nationkey long"), "lineitem": ([(1, 5), (1, 55), (20, 55), (20, 120), (20, 120)], "l_suppkey long, l_partkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.src, r.dst) for r in graphs_queries.edges(spark, str(tmp_path)).collect()}
    assert got == {("n7", "r3"), ("n8", "r2"), ("s1", "n7"), ("s20", "n8"), ("s1", "p5"), ("s1", "p55"), ("s20", "p55"), ("s20", "p120")}
    assert {r.id: r.component for r in graphs_queries.connected_components(spark, str(tmp_path)).collect()} == dict.fromkeys({x for e in got for x in e}, "n7")
    assert {r.path for r in graphs_queries.all_simple_paths(spark, str(tmp_path)).collect()} == {"s1>n7>r3", "s20>n8>r2"}


def test_levels_put_cycles_last(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {r.id: r.level for r in graph.levels(e).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3}


def test_coherence_without_pairs_equals_pairs(spark):
    rng = np.random.default_rng(0)
    vs = rng.normal(size=(6, 4))
    df = spark.createDataFrame([(0, [float(x) for x in v]) for v in vs] + [(1, [1.0, 0.0, 0.0, 0.0])], "g int, v array<double>")
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    want = (u @ u.T)[np.triu_indices(6, 1)].mean()
    got = {r.g: r.coherence for r in retrieval.coherence(df, "g").collect()}
    assert got[0] == pytest.approx(want) and got[1] == 0.7


def test_sections(spark):
    text = "intro\nITEM 1. Business\nx\nITEM 1A. Risk\ny\nITEM 7. MD\nz"
    df = spark.createDataFrame([(1, text), (2, "no headings")], "doc_id long, text string")
    got = [(r.doc_id, r.title) for r in retrieval.sections(df).orderBy("doc_id", "section_index").collect()]
    assert got == [(1, ""), (1, "ITEM 1"), (1, "ITEM 1A"), (1, "ITEM 7"), (2, "")]


def test_versions_and_latest(spark):
    rows = [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, "a")]
    df = spark.createDataFrame(rows, "key string, t int, digest string")
    assert [r.version for r in store.versions(df, "key", "t", "digest").orderBy("t").collect()] == [1, 1, 2, 3]
    assert store.latest(df, ["key"], ["t"]).collect()[0].t == 4


def test_cooldown_and_rate(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m)) for m in (0, 5, 20, 25, 40, 90)]
    df = spark.createDataFrame(rows, "rule_id int, ts timestamp_ntz")
    minutes = lambda d: sorted((r.ts - t0).seconds // 60 for r in d.collect())
    assert minutes(alerts.cooled_down(df, 15, 10)) == [0, 20, 40, 90]
    assert minutes(alerts.cooled_down(df, 0, 2)) == [0, 5, 90]


def test_simulation_is_the_same_on_any_partitioning(spark):
    assets = pd.DataFrame({"symbol": ["a", "b"], "weight": [0.5, 0.5], "mu": [0.0, 0.0], "sigma": [0.2, 0.3]})
    corr = np.array([[1, 0.3], [0.3, 1]])
    a = portfolio.monte_carlo(spark, assets, corr, 200, 5, parts=1).orderBy("sim").collect()
    assert a == portfolio.monte_carlo(spark, assets, corr, 200, 5, parts=7).orderBy("sim").collect()
    assert len(a) == 200


def test_factor_model_recovers_betas(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(300, 2))
    y = 0.001 + f @ np.array([1.5, -0.5]) + rng.normal(size=300) * 1e-6
    df = spark.createDataFrame([("p", float(a), float(b), float(c)) for (a, b), c in zip(f, y)], "portfolio string, x double, z double, r double")
    r = portfolio.factor_model(df, ["x", "z"], "portfolio").collect()[0]
    assert (r.beta_x, r.beta_z, r.alpha / 252) == pytest.approx((1.5, -0.5, 0.001), abs=1e-5) and r.r2 > 0.999


def test_registry_contract(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() == 5
    assert q["risk_wide_row"](spark, SF).columns == entry.entry(spark).columns


def test_question_words_end_before_letters_beyond_ascii(spark):
    asked = ["Doñez ñta del", "do you", "done", "do_it", "do", "İs it so", "Why\u0301 so", "yes?"]
    rows = [(i, t, role, text) for i, q in enumerate(asked) for t, role, text in ((1, "user", q), (2, "assistant", "a"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.conv_id for r in scoring.question_answers(df).collect()) == [0, 1, 4, 5, 6, 7]
