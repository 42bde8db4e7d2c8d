"""Benchmark decontamination: BM25 over test items with block-max WAND, confirmed on 5-word shingles.

The test items are the index: each is cut into pieces of at most PIECE words, and every word has a posting list of
pieces, ascending, with its BM25 weight, in blocks of BLOCK postings whose maxima are kept. Weights are divided by the
piece's score against itself, so one threshold serves all pieces: THRESHOLD of a verbatim copy's score.

Every training passage is a query: windows of 2 * PIECE words that start every PIECE words, so each run of up to PIECE
words lies within one window. Words are looked up once per text. Pieces form up to GROUPS groups; if in no group (nor in
a finer part of one) the greatest weights of a window's words add up to the threshold, the window can hold no piece and is passed over, by
running sums over the whole text. All others are queries for block-max WAND: the word cursors are kept in order of their pieces, the pivot is the first piece that their
greatest weights can lift over the threshold, blocks whose maxima can't are skipped over whole, and every piece that
reaches the threshold is retrieved.

A retrieved item is confirmed on the window's words around it: at least CONTAINED of the distinct 5-word shingles of its
question and of its answer must occur in the passage. The answer is the item's last sentence or line, the question the
rest; an item of one sentence is all question; a part of fewer than 5 words must occur as a whole.

The index is sent to every task in blocks of at most ITEMS items, so its size is bounded whatever the benchmark's; each
block is one pass over the documents. Words are compared without case and without marks around them.

Defined results: null and empty texts and items match nothing; items that share a text are all reported; repeated
documents are reported each; ties need no order, since every match is kept; an empty table on either side gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging, bounded_batches

PIECE, BLOCK, ITEMS = 32, 16, 20_000
GROUPS, FINE, MEMO = 16, 8, 500_000
K1, B = 1.2, 0.75
THRESHOLD = 0.65
SHINGLE, CONTAINED = 5, 0.8
BROADCAST_IDS = 2_000_000
MARKS = ".,;:!?\"'()[]{}*#$%&|<>"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
OUT = "doc_id long, item_id long, score double, question double, answer double"


def words(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(MARKS))]


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer."""
    sentences = [s for s in SENTENCE.split(text or "") if words(s)]
    if len(sentences) < 2:
        return words(text), []
    return words(" ".join(sentences[:-1])), words(sentences[-1])


def shingle_set(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else ({tuple(w)} if w else set())


class Memo(dict):
    """Term ids of words as they stand in texts: -1 for marks only, `last` for words of no item; bounded."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids, self.last = ids, len(ids)

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMO:
            self.clear()
        w = raw.strip(MARKS)
        found = self[raw] = self.ids.get(w, self.last) if w else -1
        return found


class Index:
    """Inverted index of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.pieces = [], []
        for item, text in items:
            w = words(text)
            if w:
                q, a = parts(text)
                for k in range(0, len(w), PIECE):
                    self.pieces.append((len(self.items), w[max(0, min(k, len(w) - PIECE)) : k + PIECE]))
                self.items.append((item, q, a))
        n = max(1, len(self.pieces))
        mean = sum(len(p) for _, p in self.pieces) / n
        df = Counter(t for _, p in self.pieces for t in set(p))
        self.ids = {t: i for i, t in enumerate(sorted(df))}
        lists = defaultdict(list)
        for k, (_, p) in enumerate(self.pieces):
            tf = Counter(p)
            norm = K1 * (1 - B + B * len(p) / mean)
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            own = sum(w.values())
            for t, x in w.items():
                lists[self.ids[t]].append((k, x / own))
        self.postings = [lists[i] for i in range(len(self.ids))]
        self.maxima = [[max(x for _, x in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.postings]
        self.best = np.array([max(x for _, x in p) for p in self.postings] + [0.0])
        self.memo = Memo(self.ids)
        # Greatest weight of each word within each group of pieces, and within FINE parts of each group.
        self.fine = np.zeros((len(self.ids) + 1, GROUPS * FINE), np.float32)
        for t, p in enumerate(self.postings):
            for k, x in p:
                g = k * GROUPS * FINE // n
                self.fine[t, g] = max(self.fine[t, g], x + 1e-6)
        self.bounds = self.fine.reshape(-1, GROUPS, FINE).max(axis=2)
        self.shingles = [(shingle_set(q), len(q), shingle_set(a), len(a)) for _, q, a in self.items]

    def retrieve(self, terms: list[int], threshold: float = THRESHOLD) -> dict[int, float]:
        """All pieces whose score for the distinct terms is at least the threshold."""
        out = {}
        cursors = sorted([self.postings[t][0][0], t, 0] for t in terms)
        while cursors:
            total, pivot = 0.0, None
            for i, (_, t, _) in enumerate(cursors):
                total += self.best[t]
                if total >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            piece = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == piece:
                pivot += 1
            # Bounds of the blocks in which the pivot piece would be.
            bound, ends = 0.0, []
            for c in cursors[: pivot + 1]:
                p, b = self.postings[c[1]], c[2] // BLOCK
                while (b + 1) * BLOCK < len(p) and p[(b + 1) * BLOCK - 1][0] < piece:
                    b += 1
                bound += self.maxima[c[1]][b]
                ends.append(p[min(len(p), (b + 1) * BLOCK) - 1][0])
            if bound >= threshold - 1e-9:
                if cursors[0][0] == piece:
                    score = sum(self.postings[c[1]][c[2]][1] for c in cursors[: pivot + 1])
                    if score >= threshold - 1e-9:
                        out[piece] = score
                    target = piece + 1
                else:
                    target = piece
            else:
                target = min(ends) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, piece + 1)
            fresh = []
            for c in cursors[: pivot + 1]:
                p, k = self.postings[c[1]], c[2]
                while k < len(p) and p[k][0] < target:
                    k = min(len(p), (k // BLOCK + 1) * BLOCK) if p[min(len(p), (k // BLOCK + 1) * BLOCK) - 1][0] < target else k + 1
                if k < len(p):
                    fresh.append([p[k][0], c[1], k])
            cursors = sorted(fresh + cursors[pivot + 1 :])
        return out

    def search(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question, answer) of the items that a text holds."""
        raw, last = (text or "").lower().split(), len(self.ids)
        at = np.fromiter(map(self.memo.__getitem__, raw), np.int64, len(raw))
        at = at[at >= 0]
        if not len(at):
            return []
        starts = np.arange(0, max(1, len(at) - PIECE), PIECE)
        stops = np.minimum(starts + 2 * PIECE, len(at))
        # Sums by steps of PIECE words, two steps a window.
        steps = np.add.reduceat(self.bounds[at], np.arange(0, len(at), PIECE), axis=0)
        sums = steps[: len(starts)].copy()
        sums[: len(steps) - 1] += steps[1 : len(starts) + 1]
        some = np.flatnonzero(sums.max(axis=1) >= THRESHOLD - 1e-9)
        found: dict[int, tuple[float, float, float]] = {}
        w = None
        for s, e in zip(starts[some], stops[some]):
            terms = np.unique(at[s:e])
            terms = terms[terms < last]
            if self.fine[terms].sum(axis=0).max() < THRESHOLD - 1e-9:
                continue
            hits = self.retrieve(terms.tolist())
            if hits and w is None:
                w = [x for r in raw if (x := r.strip(MARKS))]
            for piece, score in hits.items():
                item = self.pieces[piece][0]
                q, nq, a, na = self.shingles[item]
                size = PIECE + nq + na
                passage = w[max(0, s - size) : e + size]
                have = shingle_set(passage) if len(passage) >= SHINGLE else set()
                held = (_held(q, nq, have, passage), _held(a, na, have, passage))
                if min(held) >= CONTAINED:
                    old = found.get(item, (0.0, 0.0, 0.0))
                    found[item] = (max(old[0], score), max(old[1], held[0]), max(old[2], held[1]))
        return [(self.items[i][0], *v) for i, v in found.items()]


def _held(part: set, n: int, have: set, passage: list[str]) -> float:
    """Share of a part's shingles in a passage; short parts are there as a whole or not."""
    if not part:
        return 1.0
    if n < SHINGLE:
        (t,) = part
        return float(any(tuple(passage[k : k + n]) == t for k in range(len(passage) - n + 1)))
    return len(part & have) / len(part)


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question, answer) of every test item that a document holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    texts, out = docs.select("doc_id", "text"), None
    parts_of = max(1, math.ceil(items.count() / block))
    numbered = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts_of)))
    for k in range(parts_of):
        held = [(r.item_id, r.text) for r in numbered.where(F.col("part") == k).collect()]  # about `block` items

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = Index(sorted(held))
            for b in batches:
                rows = [(d, *m) for d, t in zip(b["doc_id"].astype("Int64"), b["text"]) for m in index.search(t)] if index.items else []
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question", "answer"]).astype({"doc_id": "Int64", "item_id": "Int64", "score": float, "question": float, "answer": float})

        found = texts.mapInPandas(run, OUT)
        out = found if out is None else out.unionByName(found)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks, scores rounded to 6."""
    return leaks(docs, benchmark).select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question", "answer")])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns; rows with a null doc_id stay."""
    gone = Staging(docs.sparkSession, "leaks").keep(leaks(docs, benchmark).select(F.col("doc_id").alias("gone")).where("gone is not null").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
