"""Extraction, bundles and the news chain on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import evidence, extraction, news


def test_layers_of_extraction(spark):
    texts = spark.createDataFrame([(1, "Big Blue Bank (NYSE) paid $5.2B, up 12% from 2023-01-05; Blue Bank sold $ABC to Big Blue Bank."), (2, None), (3, " "), (4, "word " * 30 + "blue bank")], "doc_id long, text string")
    names = spark.createDataFrame([("Big Blue Bank", "company", 0.7), ("Blue Bank", "company", 0.6), ("blue bank", "place", 0.1)], "phrase string, kind string, confidence double").where("kind = 'company'")
    kept, related = extraction.extract(texts, names, 3)
    got = {(r.id, r.kind, r.entity): (r.mentions, r.methods, r.confidence) for r in kept.collect()}
    assert got[1, "company", "big blue bank"] == (2, "dictionary", 0.75)  # the shorter name inside it doesn't count
    assert got[1, "company", "blue bank"] == (1, "dictionary", 0.6) and got[4, "company", "blue bank"][0] == 1
    assert got[1, "money", "$5.2b"][2] == 0.9 and (1, "percent", "12%") in got and (1, "ticker", "$abc") in got and (1, "date", "2023-01-05") in got
    pairs = {(r.a, r.b) for r in related.where("id = 1").collect()}
    assert {("big blue bank", "$5.2b"), ("$5.2b", "12%"), ("blue bank", "$abc"), ("$abc", "big blue bank")} <= pairs
    assert {r.id for r in kept.collect()} == {1, 4}


def test_confidence_and_distance_bound_what_is_kept(spark):
    texts = spark.createDataFrame([(1, "12345 " + "x " * 13 + "7%" + " y" * 12 + " 8%")], "doc_id long, text string")
    none = spark.createDataFrame([], "phrase string, kind string, confidence double")
    kept, related = extraction.extract(texts, none, 1)
    assert {r.entity for r in kept.collect()} == {"7%", "8%"}  # a bare number is below the threshold
    assert [(r.a, r.b, r.n) for r in related.collect()] == [("7%", "8%", 1)]


def test_texts_are_read_once_and_phrases_meet_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(extraction, "AT_ONCE", 8, raising=False)
    monkeypatch.setattr(extraction, "REMEMBERED", 3, raising=False)
    rows = [(i, f"Ébano Río {i}000 (Ébano río), {'x ' * i}ébano ,, RÍO $ABC.") for i in range(20)] + [(20, ""), (21, "Río")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame([("ébano río", "place", 0.6), ("Río", "river", 0.7)], "phrase string, kind string, confidence double")
    kept, _ = extraction.extract(texts, names, 2)
    got = {(r.id, r.entity): r.mentions for r in kept.collect()}
    # Inside the longer phrase the shorter one doesn't count; a word of punctuation parts two words.
    assert got == {**{(i, e): n for i in range(20) for e, n in (("ébano río", 2), ("río", 1), ("$abc", 1))}, (21, "río"): 1}
    # Tokens and n-grams aren't rows: nothing is exploded but places of what was found.
    plan = extraction.mentions(texts, names, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Scan") + plan.count("Relation") + plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4


def test_bundles_equal_pairs(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(40):
        v = None if i % 9 == 0 else [float(x) for x in rnd.normal(size=5)]
        rows.append((i, [["a"], ["a", "b"], None, ["c"] if i < 4 else ["a", "a"]][i % 4], v, float(i % 10) / 10, f"k{i % 3}", [None, "supporting", "opposing"][i % 3]))
    got = {r.theme: r for r in evidence.bundles(spark.createDataFrame(rows, "id int, entities array<string>, v array<double>, relevance double, kind string, stance string")).collect()}
    themes = {}
    for r in rows:
        for t in set(r[1] or ["general"]):
            themes.setdefault(t, []).append(r)
    assert set(got) == {t for t, m in themes.items() if len(m) >= 2}
    for t, g in got.items():
        m = themes[t]
        u = [np.array(r[2]) / np.linalg.norm(r[2]) for r in m if r[2]]
        pairs = [a @ b for a, b in itertools.combinations(u, 2)]
        stances = [r[5] or "neutral" for r in m]
        assert g.n == len(m) and g.coherence == pytest.approx(np.mean(pairs) if pairs else 0.7)
        assert g.coverage == pytest.approx(min(1, 0.7 * np.mean([r[3] for r in m]) + 0.3 * len({r[4] for r in m}) / 10))
        assert g.consensus == pytest.approx(max(stances.count(s) for s in stances) / len(m))


def article(i, title, content, url, source="s"):
    return (i, title, "", content, url, source, "en")


def test_chain_takes_the_first_provider_and_drops_repeats(spark):
    kind = "article_id long, title string, summary string, content string, url string, source string, lang string"
    first = [article(1, "Record profit at Acme", "<p>Acme made a <b>record</b> profit.</p>", "https://www.a.com/x?utm_source=q", "first")]
    second = [article(2, "Acme profit", "other words for one url", "https://a.com/x/"), article(3, "Record profits at Acme", "quite another body of text about Acme", "https://b.com/y"), article(4, "Weather", "sunny", "https://c.com/z"), article(5, "Nothing", None, "https://d.com/z")]
    parts = {k: F.lit(0.5) for k in news.COMPOSITE} | {"relevance": F.when(F.col("title") == "Weather", 0.0).otherwise(1.0), "impact": F.lit(None).cast("double")}
    d = [spark.createDataFrame(rows, kind) for rows in (first, second)]
    got = {r.article_id: r for r in news.process(d, parts, most=10).collect()}
    assert set(got) == {1, 4, 5} and got[1].content == "Acme made a record profit." and got[1].priority == 0
    assert got[1].composite == pytest.approx(0.25 + 0.5 * 0.65) and got[4].rank == 3
    assert {r.article_id for r in news.process(d, parts, most=1, similar=False).collect()} == {1}
