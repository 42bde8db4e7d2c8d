"""Collocations against counts of every phrase."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from orrery.llm import phrases

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least, longest=5, top=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inner = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * counts[p[i:j]]}
        found = []
        for p in cand.keys() - inner:
            a = cand[p]
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((lang, " ".join(p), a, l, r, n[lang], score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[:top])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(lang, t, "x") for lang, t in rows], "lang string, text string, phrase string")
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_rows(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = ["The", "cat", "Été", "sat", "on", "a", "mat", "a", "a", "zzü"]
    text = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rnd.randrange(0, 60)))
    fixed = "once upon a time there was"
    return [(rnd.choice(["en", "en", "en", "de", None]), rnd.choice([text(), fixed, fixed + " a king. " + text()])) for _ in range(n)]


def test_equals_brute_force(spark):
    for least in (2, 10, 40):
        assert run(spark, some_rows(), least=least) == brute(some_rows(), least)


def test_few_places_and_small_buckets_change_nothing(spark, monkeypatch):
    want = run(spark, some_rows(2), least=5)
    monkeypatch.setattr(phrases, "TABLE", 7)
    monkeypatch.setattr(phrases, "HELD", 3)
    assert run(spark, some_rows(2), least=5) == want == brute(some_rows(2), 5)


def test_pieces_are_cut_down_to_what_can_hold_longer_phrases():
    table = np.zeros(1 << 13, np.uint8)
    pairs = [("en", b"a b"), ("en", b"b c"), ("en", b"c d"), ("de", b"x y"), ("de", b"y x")]
    for lang, pair in pairs:
        bit = phrases.places_of(pair.split(), np.full(2, zlib.crc32(lang.encode()), np.uint64), 2, 16)[0]
        table[bit >> 3] |= 1 << (bit & 7)
    rows = [("en", b"q a b c d q b c q a b c", 3), ("en", b"a b c", 2), ("en", b"c", 1), ("en", b"d a b", 1), ("de", b"a b c", 5), ("de", b"x y x y", 1), ("de", b"q", 9)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=["lang", "piece", "m"])
    got = sorted(tuple(r.values()) for b in phrases._stretches(iter([batch, batch]), 2, table, 1000) for r in b.to_pylist())
    assert got == [("de", b"x y x y", 2), ("en", b"a b c", 10), ("en", b"a b c d", 6)]


def test_only_what_is_cut_down_is_read_for_longer_phrases(spark):
    seen = {}
    rows = [("en", "one two three"), ("en", "one two three"), *[("en", f"w{i} v{i} u{i}") for i in range(50)]]
    stage = phrases.Staging(spark, "test")
    keep = stage.keep
    stage.keep = lambda df: seen.setdefault(len(seen), keep(df))
    phrases.frequent(stage, phrases.pieces(spark.createDataFrame(rows, "lang string, text string")), 2)
    cut = [df for df in seen.values() if df.columns == ["lang", "piece", "m"]]
    assert [[(r.lang, bytes(r.piece), r.m) for r in df.collect()] for df in cut] == [[("en", b"one two three", 2)]]


def test_ties_edges_and_top(spark):
    rows = [("en", "b a b a b a"), ("en", "b a b a b a"), ("en", None), ("en", ""), ("en", " ,.; "), (None, "x y x y"), ("de", "한 ß " * 30), ("en", "w " * 5000)]
    assert run(spark, rows, least=2) == brute(rows, 2)
    assert run(spark, rows, least=2, top=1) == brute(rows, 2, top=1)
    assert run(spark, [], least=2) == []


def test_scores_beyond_64_bits(spark):
    df = spark.sql("select cast(5000000000 as bigint) a, cast(90000000000000 as bigint) n, cast(6000000000 as bigint) l, cast(7000000000 as bigint) r")
    got = df.selectExpr("(1000 * cast(a as decimal(38, 0)) * n) div (cast(l as decimal(38, 0)) * r) s").first().s
    assert got == 1000 * 5000000000 * 90000000000000 // (6000000000 * 7000000000)
