"""Entities of whole texts in layers: rules on tokens, a dictionary by longest match, merging, confidence, relations.

Tokens are words between white space without the punctuation around them, counted from 0. Each task cleans a word and asks it
the rules once, however often it comes. The dictionary is a table of any size: of the token n-grams up to its longest entry,
those whose place in a bit table of fixed size is set meet it in an equi-join, one row a text and phrase with all places.
Spans inside a longer one go by a running maximum over a text's spans. Relations join neighbours in the order of places, so
they are as many as mentions, not their square.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.graph import cut

#: Fixed patterns of single tokens, first match wins, with the confidence of each.
RULES = [
    ("money", "^[$€£][0-9][0-9,]*(?:\\.[0-9]+)?[KMBkmb]?$", 0.9),
    ("percent", "^[0-9]+(?:\\.[0-9]+)?%$", 0.9),
    ("basis_points", "^[0-9]+bps?$", 0.9),
    ("ticker", "^\\$[A-Z]{1,5}$", 0.85),
    ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0.9),
    ("email", "^[A-Za-z0-9._]+@[A-Za-z0-9.]+\\.[A-Za-z]+$", 0.9),
    ("filing", "^(?:10-K|10-Q|8-K)$", 0.95),
    ("number", "^[0-9]{4,}$", 0.4),
]
#: Every rule needs one of these.
HINT = "[0-9$€£@]"
EDGES = "[\"'(\\[{.,;:!?)\\]}]+"


#: Bits of the table that tells which phrases may be in a dictionary, as a power of two (8 MB).
BITS = 26
#: Characters of texts that are cut into words at once; words that a task remembers.
AT_ONCE, REMEMBERED = 4_000_000, 500_000
_AROUND = "\"'([{.,;:!?)]}"


def mentions(texts: DataFrame, entries: DataFrame, longest: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, at, n, kind, entity, confidence, method) of the tokens that a rule fits, and of the phrases of a dictionary (phrase,
    kind, confidence) of up to `longest` tokens, case aside; of the latter's spans one of which lies inside the other only the
    longer one stays."""
    spark = texts.sparkSession
    listed = cut(entries.withColumn("phrase", F.lower("phrase")).withColumn("n", F.size(F.split("phrase", " "))).where(F.col("n") <= longest).dropDuplicates(["phrase"]).select("phrase", "n", "kind", "confidence"))
    place = F.crc32("phrase") % (1 << BITS)
    words = listed.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(crc32(phrase) % {1 << BITS} & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    bits = spark.sparkContext.broadcast(table.view(np.uint64))
    kind = texts.schema[id].dataType.simpleString()
    schema = f"id {kind}, entity string, n int, kind string, confidence double, places array<int>"
    seen = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: _seen(b, bits.value, longest), schema)
    rules = seen.where("kind is not null").select("id", F.explode("places").alias("at"), "n", "kind", "entity", "confidence", F.lit("rule").alias("method"))
    known = seen.where("kind is null").select("id", F.col("entity").alias("phrase"), "n", "places").join(listed, ["phrase", "n"])
    spans = known.select("id", F.explode("places").alias("at"), "n", "kind", F.col("phrase").alias("entity"), "confidence", F.lit("dictionary").alias("method"))
    before = Window.partitionBy("id").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_end", F.max(F.col("at") + F.col("n")).over(before)).where("_end is null or at + n > _end").drop("_end")
    return rules.unionByName(spans)


def _seen(batches: Iterator[pa.RecordBatch], bits: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """(id, entity, n, kind, confidence, places) of rules' tokens, and without kind and confidence of phrases that may be listed."""
    rules, hint = [(k, re.compile(p), c) for k, p, c in RULES], re.compile(HINT)
    memo: dict = {}

    def learn(w: bytes) -> tuple:
        if len(memo) >= REMEMBERED:
            memo.clear()
        token = w.decode().strip(_AROUND)
        low = token.lower().encode()
        fits = next(((k, c) for k, p, c in rules if p.fullmatch(token)), None) if hint.search(token) else None
        memo[w] = out = (low, b" " + low, zlib.crc32(low), fits)
        return out

    for batch in batches:
        rows, held, first = [], 0, 0
        texts = batch.column(1).to_pylist()
        for k, t in enumerate(texts):
            rows.append((t or "").encode().split())  # at [\x20\x09-\x0D]
            held += len(t or "")
            if held >= AT_ONCE or k == len(texts) - 1:
                yield _batch(batch.column(0), first, [[memo.get(w) or learn(w) for w in ws] for ws in rows], bits, longest)
                rows, held, first = [], 0, k + 1


def _batch(ids: pa.Array, first: int, rows: list, bits: np.ndarray, longest: int) -> pa.RecordBatch:
    found: dict = {}
    sizes = np.array([len(r) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = [w for r in rows for w in r]
    for i in [i for i, w in enumerate(words) if w[3]]:
        found.setdefault((int(row[i]), words[i][0], 1, words[i][3]), []).append(int(at[i]))
    tails, sums = [w[1] for w in words], [w[2] for w in words]
    for n in range(1, longest + 1):
        if n > 1:
            sums = list(map(zlib.crc32, tails[n - 1 :], sums))
        h = np.array(sums, np.int64) & ((1 << BITS) - 1)
        listed = (bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
        for i in np.flatnonzero(listed & (at[: len(h)] + n <= sizes[row[: len(h)]])).tolist():
            phrase = words[i][0] + b"".join(tails[i + 1 : i + n])
            found.setdefault((int(row[i]), phrase, n, None), []).append(int(at[i]))
    keys = list(found)
    which = ids.take(pa.array([first + k[0] for k in keys], pa.int64()))
    entity = pa.array([k[1] for k in keys], pa.binary()).cast(pa.string())
    kinds, scores = (pa.array([k[3] and k[3][x] for k in keys], t) for x, t in ((0, pa.string()), (1, pa.float64())))
    return pa.RecordBatch.from_arrays([which, entity, pa.array([k[2] for k in keys], pa.int32()), kinds, scores, pa.array(list(found.values()), pa.list_(pa.int32()))], ["id", "entity", "n", "kind", "confidence", "places"])


def merged(mentions: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, kind, entity, mentions, methods, confidence): the best confidence, .1 more for each further method and .05 for each
    further mention up to .15, at most 1; those below `least` go."""
    g = mentions.groupBy("id", "kind", "entity").agg(F.count(F.lit(1)).alias("mentions"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.count_distinct("method").alias("k"), F.max("confidence").alias("best"))
    score = F.least(F.lit(1.0), F.col("best") + 0.1 * (F.col("k") - 1) + F.least(0.05 * (F.col("mentions") - 1), F.lit(0.15)))
    return g.withColumn("confidence", F.round(score, 6)).where(F.col("confidence") >= least).drop("k", "best")


def relations(mentions: DataFrame, kept: DataFrame, within: int = 12) -> DataFrame:
    """(id, a, b, n): entities that follow one another, without another one between, at most `within` tokens apart."""
    d = mentions.join(kept.select("id", "kind", "entity"), ["id", "kind", "entity"], "left_semi")
    w = Window.partitionBy("id").orderBy("at", "n", "kind", "entity")
    d = d.withColumn("b", F.lead("entity").over(w)).withColumn("gap", F.lead("at").over(w) - F.col("at") - F.col("n"))
    return d.where((F.col("gap") <= within) & (F.col("b") != F.col("entity"))).groupBy("id", F.col("entity").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


def extract(texts: DataFrame, entries: DataFrame, longest: int, least: float = 0.5, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The entities of each text, and the relations between them."""
    found = cut(mentions(texts, entries, longest, id, text))
    kept = merged(found, least)
    return kept, relations(found, kept)
