"""The quality classifier: held-out accuracy on planted structure, determinism and edge cases; and the whole pipeline."""

import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from orrery.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, score double"


def rows(n=240):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(rng.randint(5, 9))]
        text = "\n".join(lines)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(f"{w}###" for w in text.split())
        docs.append((i, text, "en", "s", len(text), "q", 1.0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = rows()
    d = spark.createDataFrame([*docs, (None, "", None, None, 0, None, None), (1000, None, "en", "s", 0, "q", 1.0)], SCHEMA)
    known = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, known).toPandas()
    assert len(got) == len(docs) + 2
    truth = {i: q for i, q, _ in labels}
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in [*truth, 1000] if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [truth[i] == p for i, p in zip(held.doc_id, held.predicted) if i in truth]
    assert np.mean(right) >= 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    kept = quality.keep_good(d, known)
    assert kept.columns == d.columns
    good = [None if i != i else int(i) for i in got[got.predicted == 1].doc_id.astype(float)]
    assert sorted(map(str, good)) == sorted(str(r.doc_id) for r in kept.collect())


def brute_features(text):
    t = text or ""
    w, ls = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    share = lambda a, b: a / max(b, 1)
    n = {k: sum(c in chars for c in t) for k, chars in quality.COUNTED.items()}
    chars = sum(map(len, w))
    return {
        "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(w)), "word_length": share(chars, len(w)),
        "symbols_per_word": share(n["symbols"], len(w)), "bangs_per_word": share(n["bangs"], len(w)), "pipes_per_word": share(n["pipes"], len(w)),
        "upper_share": share(n["upper"], chars), "lower_share": share(n["lower"], chars), "digit_share": share(n["digits"], chars),
        "stops_per_word": share(n["stops"], len(w)), "marks_per_word": share(n["marks"], len(w)), "words_per_line": share(len(w), len(ls)),
        "distinct_words": share(len(set(w)), len(w)), "distinct_lines": share(len(set(ls)), len(ls)),
        "repeats_in_a_row": share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
    }


def brute_score(model, x):
    """The model read as what it says: for each table the cell whose edges a value lies between, all added up."""
    cell = lambda edges, v: sum(v >= e for e in edges)
    total = model.base + sum(t[cell(e, v)] for e, t, v in zip(model.edges, model.tables, x))
    total += sum(t[cell(e, x[i]), cell(f, x[j])] for (i, j), (e, f), t in zip(model.pairs, model.pair_edges, model.pair_tables))
    return 1 / (1 + math.exp(-total))


def test_scores_equal_brute_force(spark):
    docs, labels = rows(150)
    odd = ["", None, " \n\t", "a a a b", "Éa ß | # !! 12.5\n\nx", "word " * 60_000, "x" * 300_000]
    docs += [(2000 + k, t, "en", "s", 0, "q", 1.0) for k, t in enumerate(odd)]
    d = spark.createDataFrame(docs, SCHEMA)
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = {r[0]: r[1] for r in docs}
    for r in quality.features(d).collect():
        want = brute_features(texts[r.doc_id])
        assert {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} == {k: r[k] for k in want}
    for r in quality.score(d, model).collect():
        assert r.score == pytest.approx(brute_score(model, list(brute_features(texts[r.doc_id]).values())), abs=1e-9)


def test_a_text_is_split_once(spark):
    docs, labels = rows(30)
    d, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for df in (quality.classify(d, known), quality.keep_good(d, known)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") == 2  # words and lines


def test_clashing_names(spark):
    docs, labels = rows(60)
    d = spark.createDataFrame([(r[0], r[1], 1.0, "w", 2) for r in docs], "doc_id long, text string, p double, row string, labelled int")
    kept = quality.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == d.columns and 0 < kept.count() < 60


def test_sample_bound_and_determinism(spark):
    docs, labels = rows(120)
    d = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = quality.train(d, known, sample=40), quality.train(d.repartition(7), known.repartition(5), sample=40)
    x = np.random.default_rng(1).random((20, len(quality.FEATURES)))
    assert np.allclose(a.score(x), b.score(x))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert m.pairs[0] == (0, 1)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)]])
def test_few_labels_and_empty_tables(spark, labels):
    docs, _ = rows(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(docs, SCHEMA), known).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert quality.classify(spark.createDataFrame([], SCHEMA), known).count() == 0


def test_pipeline_on_sample(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read, counts = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, read, sf)
        assert out.columns == docs.columns
        read = spark.createDataFrame(out.toPandas(), out.schema)
        counts.append(read.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < docs.count()
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == counts[-1]
