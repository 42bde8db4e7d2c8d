"""Periodic runs against a search of all periods."""

import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

from orrery.llm import periods

WHITE = " \t\n\x0b\x0c\r"


def brute(w):
    """Maximal stretches of every period, each interval under its smallest one."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(text):
    out, now = [], ""
    for ch in text or "":
        if ch in WHITE:
            if now:
                out.append(now)
            now = ""
        else:
            now += ch
    return out + ([now] if now else [])


def row(doc_id, text):
    w = words_of(text)
    n = len(w)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda s: sha256(s.encode()).hexdigest()
    one = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(runs), *one, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


def random_words(rnd):
    n, a, out = rnd.choice([0, 1, 5, 23, 24, 25, 40, 100, 300]), rnd.choice([1, 2, 3, 50]), []
    while len(out) < n:
        out += [b"%d" % rnd.randrange(a) for _ in range(rnd.randrange(1, 30))] * (rnd.randrange(1, 9) if rnd.random() < 0.6 else 1)
    return out


def test_runs_equal_brute_force():
    rnd, total = random.Random(5), 0
    for _ in range(150):
        texts = [random_words(rnd) for _ in range(rnd.randrange(1, 6))]
        want = [brute(w) for w in texts]
        assert periods.runs_of(texts) == want
        total += sum(map(len, want))
        for w, runs in zip(texts, want):
            drop = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert periods.collapsed(w, runs) == [x for i, x in enumerate(w) if i not in drop]
    assert total > 200


def test_fibonacci_and_thue_morse_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    t = [b"x"]
    while len(t) < 512:
        t = t + [b"y" if c == b"x" else b"x" for c in t]
    assert periods.runs_of([b, t]) == [brute(b), []] and brute(b)


def test_query_equals_brute_force_and_edges(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(x.decode() for x in random_words(rnd))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a " * 30), (103, "a " * 30), (None, "b c " * 20), (104, "ab cd\x1cef " * 40), (105, "x " * 20_000)]
    got = periods.digest(spark.createDataFrame([(i, t, "shadow", 1) for i, t in rows], "doc_id long, text string, n_runs string, start int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[6])
    small = [r for r in rows if r[0] != 105]
    assert sorted((tuple(r) for r in got if r.doc_id != 105), key=key) == sorted((row(*r) for r in small), key=key)
    long = next(r for r in got if r.doc_id == 105)
    assert long.n_runs == 1 and long.collapsed_sha256 == sha256(b"x").hexdigest() if crc32(b"105") % 10 else long.n_runs >= 1


def test_empty_table_and_texts_without_repetitions(spark):
    assert periods.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = periods.find(spark.createDataFrame([(1, "go " + "la di " * 15 + "end")], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in out.runs] == [(1, 30, 2)] and out.text == "go la di end"


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 9000")
    want = {r.doc_id: row(r.doc_id, r.text) for r in df.collect()}
    assert {r.doc_id: tuple(r) for r in periods.digest(df).collect()} == want
