"""Line dedup, near-duplicates and decontamination against brute force and edge cases."""

import hashlib
import random
import re
from math import comb

import pytest

import corpus_pipeline
from orrery.llm import decontam, linededup, links, neardup
from orrery.llm.common import Staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_chars long, cid long, gone long, h string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, n, alphabet="abcé "):
    s = list(text)
    for _ in range(n):
        p, kind = rng.randint(0, len(s)), rng.random()
        if kind < 0.34 and s:
            s[min(p, len(s) - 1)] = rng.choice(alphabet)
        elif kind < 0.67 and s:
            del s[min(p, len(s) - 1)]
        else:
            s.insert(p, rng.choice(alphabet))
    return "".join(s)


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda n=8: " ".join(rng.choice(vocabulary) for _ in range(n))
    hot, base = line(), [line() for _ in range(12)]
    texts = [None, "", " \n ", "one two", "one  TWO", "tiny", hot, hot]
    for _ in range(30):
        lines = [hot] + [line() for _ in range(3)] + [mutated(rng, rng.choice(base), rng.randint(0, 3))]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    for _ in range(25):  # a chain and a cloud of near copies
        words = " ".join(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["x" * 3000 + " " + line(2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (9, "another text of a doc_id in use"), (None, texts[10])]
    return [(i, t, "en", len(t or ""), 7, 7, "h") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_banded_distance(spark):
    rng = random.Random(2)
    pairs = [(a := "".join(rng.choice("abcé") for _ in range(rng.randint(0, 14))), mutated(rng, a, rng.randint(0, 4), "abc")) for _ in range(600)]
    df = spark.createDataFrame(pairs, "p string, q string")
    for e in (1, 2, 3):
        for r in df.select("p", "q", linededup.within("p", "q", e).alias("w")).collect():
            assert r.w == (distance(r.p, r.q) <= e), (r, e)


@pytest.mark.parametrize("bound, roomy", [(10**6, 4), (0, -1)])
def test_lines_equal_brute_force(spark, docs, monkeypatch, bound, roomy):
    monkeypatch.setattr(linededup, "BROADCAST_IDS", bound)
    monkeypatch.setattr(linededup, "link", lambda *a: links.link(*a, roomy=roomy))
    rows = corpus()
    if roomy < 0:  # variants of one line, and of short lines too
        rng = random.Random(9)
        line = " ".join(rng.choice("stone river lamp green idea".split()) for _ in range(14))
        some = [mutated(rng, line, rng.randint(0, 5)) for _ in range(50)] + [mutated(rng, line[:k], rng.randint(0, 2)) for k in (8, 11, 12, 13, 23, 24, 25) for _ in range(5)]
        rows += [(100 + k, "\n".join(some[k::4]), "en", 0, 7, 7, "h") for k in range(4)]
        rows = [(*r[:3], len(r[1] or ""), *r[4:]) for r in rows]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    order = lambda i: (i is not None, i or 0)
    lines = sorted(((order(i), p, x) for i, t, *_ in rows for p, x in enumerate((t or "").split("\n")) if WORD.search(x)))
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [x for x in first if len(x) < 500]
    for k, a in enumerate(long):
        for b in long[:k]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 12):
                root[find(a)] = find(b)
    stays = {}
    for x, at in first.items():
        stays[find(x)] = min(stays.get(find(x), at), at)

    def want(i, t):
        kept, exact, near = [], 0, 0
        for p, x in enumerate((t or "").split("\n")):
            if WORD.search(x) and stays[find(x)] != (order(i), p):
                near, exact = (near + 1, exact) if first[x] == (order(i), p) else (near, exact + 1)
            else:
                kept.append(x)
        return exact, near, "\n".join(kept)

    expected = sorted((order(i), *want(i, t)[:2], hashlib.sha256(want(i, t)[2].encode()).hexdigest()) for i, t, *_ in rows)
    got = sorted((order(r.doc_id), r.n_exact, r.n_near, r.kept_sha256) for r in linededup.digest(docs).collect())
    assert got == expected
    assert sum(e[2] for e in expected) > 3
    cleaned = linededup.clean(docs)
    assert cleaned.columns == docs.columns
    texts = sorted((order(i), w[2]) for i, t, *_ in rows for w in [want(i, t)] if w[0] + w[1] == 0 or WORD.search(w[2]))
    assert sorted((order(r.doc_id), r.text or "") for r in cleaned.collect()) == texts
    assert all(r.n_chars == len(r.text or "") for r in cleaned.collect())


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("stars, roomy, bound", [(4, 4, 10**6), (1, -1, 0)])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, stars, roomy, bound):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", bound)
    monkeypatch.setattr(neardup, "link", lambda *a: links.link(*a, stars=stars, roomy=roomy))
    rows = [r[:2] for r in corpus()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    got = neardup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)
    assert len({w[2] for w in want}) < len(want) - 10
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in got if not r.kept}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in gone or d is None)


def test_chunks_guarantee_all_pairs_under_the_distance():
    rng = random.Random(1)
    for _ in range(300):
        places = rng.sample(range(neardup.PLACES), neardup.CHUNKS * 2 - 1)
        errors = [sum(p // neardup.WIDTH == c for p in places) for c in range(neardup.CHUNKS)]
        assert min(errors) <= 1


def test_pipeline_drops_pairs_from_a_similarity_of_eighty_percent(spark):
    words = [f"w{i}" for i in range(100)]
    texts = {1: words, 2: words[:88] + ["other"] * 12, 3: words[:60] + ["else"] * 40}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    share = lambda a, b: len(a & b) / len(a | b)
    a, b, c = (shingles(t) for _, t in rows)
    assert 0.8 <= share(a, b) < 0.85 and share(a, c) < 0.8 and share(b, c) < 0.8
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_fit_the_similarity(percent):
    chunks, s = neardup.chunks_for(percent), percent / 100
    places = chunks * neardup.WIDTH
    assert (1 - s**5 - 5 * (1 - s) * s**4) ** chunks < 1e-6
    assert sum(comb(places, k) * (1 - s) ** k * s ** (places - k) for k in range(neardup.far_for(percent) + 1, places + 1)) < 1e-7


def test_components_of_long_chains(spark):
    n = 40
    pairs = [(i, i + 1) for i in range(0, n - 1) if i != 20]
    stage = Staging(spark, "test")
    labels = stage.keep(spark.range(n).selectExpr("id as cid", "id as label"))
    got = {r.cid: r.label for r in links.components(stage, labels, spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(n)}


ITEMS = [
    (1, "What is the tallest tower that was built in the old town by the river? It is the red tower of stone and iron."),
    (2, "short item"),
    (3, None),
    (4, ""),
    (5, " ".join(f"word{i} thing{i % 7}" for i in range(60)) + ". The final answer here is forty two."),
    (6, "short item"),
]


def test_decontamination_finds_whole_items_only(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice("the of and river stone tower iron lamp green idea what is".split()) for _ in range(n))
    texts = [None, "", noise(400)]
    texts += [noise(90) + " " + t.upper() + " " + noise(50) for _, t in ITEMS if t]
    texts += [noise(200) + ITEMS[0][1][:70] + noise(50), "short\n item!", ITEMS[0][1].replace("old", "new")]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x"), (None, texts[4], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, score string")
    bench = spark.createDataFrame([(*r, 5) for r in ITEMS], "item_id long, text string, doc_id long")

    def brute(text):
        w = decontam.words(text)
        out = set()
        for item, t in ITEMS:
            held = []
            for part in decontam.parts(t) if decontam.words(t) else ():
                s = decontam.shingle_set(part)
                have = {tuple(w[k : k + len(next(iter(s)))]) for k in range(len(w))} if s else set()
                held.append(len(s & have) / len(s) if s else 1.0)
            if held and min(held) >= decontam.CONTAINED:
                out.add(item)
        return out

    want = sorted((str(d), i) for d, t, *_ in rows for i in brute(t))
    for block in (100, 2):
        assert sorted((str(r.doc_id), r.item_id) for r in decontam.leaks(docs, bench, block).collect()) == want
    assert len(want) >= 8
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in rows if str(d) not in bad or d is None)


def test_block_max_wand_equals_exhaustive_scoring():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 50)))) for i in range(150)])
    for _ in range(200):
        terms, threshold = rng.sample(range(len(index.ids)), rng.randint(1, 30)), rng.choice([0.02, 0.1, 0.3])
        score = {}
        for t in terms:
            for piece, x in index.postings[t]:
                score[piece] = score.get(piece, 0) + x
        assert index.retrieve(terms, threshold) == pytest.approx({p: s for p, s in score.items() if s >= threshold - 1e-9})


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert linededup.digest(none).count() == linededup.clean(none).count() == 0
    assert neardup.near_duplicates(none).count() == neardup.keep_first(none).count() == 0
    some = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert decontam.report(some, bench).count() == 0
    assert decontam.report(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontam.keep_clean(some, bench).count() == 1


def test_linked_lines_share_a_key(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abcé ") for _ in range(rng.choice([12, 13, 17, 23, 24, 25, 26, 31, 32, 33, 36, 47, 48, 49, 50, 90])))
        pairs.append((a, mutated(rng, a, min(2, len(a) // 12))))
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) >= 12 and distance(a, b) <= min(2, min(len(a), len(b)) // 12)]
    lines = spark.createDataFrame([(2 * i + k, x, len(x)) for i, p in enumerate(pairs) for k, x in enumerate(p)], "h long, line string, n int")
    keys = {}
    for r in linededup.keyed(lines).collect():
        keys.setdefault(r.h, set()).add(r.key)
    assert len(pairs) > 1000 and all(keys[2 * i] & keys[2 * i + 1] for i in range(len(pairs)))
    # What is shuffled: few keys a line, however many lines there are.
    assert sum(map(len, keys.values())) < 6 * len(keys)


@pytest.mark.parametrize("bound, spread", [(10**6, 16), (10, 10**5), (0, 0)])
def test_lines_of_any_number_and_frequency(spark, docs, monkeypatch, bound, spread):
    want = sorted(map(str, linededup.digest(docs).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_IDS", bound)
    monkeypatch.setattr(linededup, "SPREAD", spread)
    monkeypatch.setattr(linededup, "HOT", 2)
    assert sorted(map(str, linededup.digest(docs).collect())) == want


def test_variants_of_one_line_give_few_pairs(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abdeghilmnoprstuw") for _ in range(7))
    base, lines, changed = [word() for _ in range(40)], [], set()
    for k in range(240):  # one of three words becomes another one; some are repeated with two edits
        words = base[:]
        words[rng.choice([3, 20, 36])] = word()
        lines.append(" ".join(words))
        if k % 12 == 0:
            changed.add(len(lines))
            lines.append(mutated(rng, lines[-1], 2, "abd"))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    compared = []

    def counted(stage, shared, items, confirm, *more):
        def counting(pairs):
            compared.append(pairs.count())
            return confirm(pairs)

        return links.link(stage, shared, items, counting, *more)

    monkeypatch.setattr(linededup, "link", counted)
    near = {r.doc_id for r in linededup.digest(docs).collect() if r.n_near}
    assert near == changed and len(near) == 20
    # All pairs that differ from a common line at the same place would be a third of 34,000.
    assert sum(compared) < 6 * len(lines)
