"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of words with smallest period q, LEAST words or more and POWER periods or more, that can't be made
longer keeping q. The words of a text are halved again and again; each run lies in one smallest part whose midpoint m it
crosses, so that q is at most a third of that part. With Z-functions of the two halves it is known, for every q at once,
how far words q apart agree to the left and to the right of m (runs that lie mainly right of m) and of m - q (mainly
left of it). Found stretches are extended over the part's border, equal intervals keep their smallest period.

Only parts that can hold such a run get Z-functions: on one side of m at least half of the run lies, so GRAM words from m
on equal those from m + q on, or the GRAM before m those before m - q. For all parts of a depth, of all texts of a batch,
this is one comparison of hashed word groups by numpy; equal groups have equal hashes, so nothing is missed. Word ids of
the parts that remain are interned and compared exactly. Time is O(n log n) for n words, plus what the runs found cover.

Texts take part as UTF-8 bytes, each on its own: no shuffle, and memory by the longest text of a batch.

Defined results: null and blank texts have no words and no run, their digests are those of nothing; a null doc_id is never
rewritten by the test's planting rule; repeated rows give equal rows; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches

LEAST, POWER = 24, 3
#: Words from the midpoint on that agree for any run: half of the longest of 24 words and three periods, less one period.
GRAM = 4
#: Words of short texts that are searched at once.
BLOCK = 400_000
FOUND = "n_runs long, start long, length long, period long, exponent_milli long"


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many elements from i on equal those from the start on; z[0] is the length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(s: list[int], least: int = LEAST, power: int = POWER) -> Iterator[tuple[int, int, int]]:
    """(start, end, q) of stretches around the midpoint of s in which elements q apart agree, long enough for a run."""
    n = len(s)
    m = n // 2
    left, right = s[:m], s[m:]
    ahead, behind = z_function(right), z_function(left[::-1])
    # From m on against the places left of it, and back from m against the places right of it: -1 is no id.
    back = z_function(right + [-1] + left)[len(right) + 1 :]
    forth = z_function(left[::-1] + [-1] + right[::-1])[m + 1 :][::-1]
    for q in range(1, n // power + 1):
        if q < len(right):  # around m: agreement of i and i + q, leftwards from i = m - 1 and rightwards from i = m
            a, b = forth[q - 1], ahead[q]
            if a == q and q < m:  # all q words before m agree: further left by what precedes them
                a += behind[q]
            if a + b + q >= max(least, power * q):
                yield m - a, m + b + q, q
        if q < m:  # around m - q
            a, b = behind[q], back[m - q]
            if b == q and q < len(right):
                b += ahead[q]
            if a + b + q >= max(least, power * q):
                yield m - q - a, m - q + b + q, q


def _hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of the GRAM words from each place on (the last places repeat the end)."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.concatenate([h, np.zeros(GRAM, np.uint64)])
    out = np.zeros(len(words), np.uint64)
    for k in range(GRAM):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) + k]
    return out


def _promising(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which parts [lo, hi) have words around their midpoint that recur a possible period away."""
    m, top = (lo + hi) // 2, (hi - lo) // POWER
    part = np.repeat(np.arange(len(lo)), top)
    q = np.arange(len(part)) - np.repeat(np.cumsum(top) - top, top) + 1
    mid = m[part]
    fit = grams[mid] == grams[np.minimum(mid + q, len(grams) - 1)]
    fit |= grams[mid - GRAM] == grams[np.maximum(mid - GRAM - q, 0)]
    out = np.zeros(len(lo), bool)
    out[part[fit]] = True
    return out


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    grams = _hashed([w for words in texts for w in words])
    doc = np.flatnonzero(sizes >= LEAST)
    lo, hi = (ends - sizes)[doc], ends[doc]
    found: list[dict] = [{} for _ in texts]
    ids: dict[int, list[int]] = {}
    while len(doc):
        for k in np.flatnonzero(_promising(grams, lo, hi)):
            d, base = int(doc[k]), int(ends[doc[k]] - sizes[doc[k]])
            if d not in ids:
                known: dict[bytes, int] = {}
                ids[d] = [known.setdefault(w, len(known)) for w in texts[d]]
            s, n, a = ids[d], int(sizes[d]), int(lo[k]) - base
            for start, end, q in crossing(s[a : int(hi[k]) - base]):
                start, end = start + a, end + a
                # What reaches the part's border may go on; then it is a run of a larger part, found there.
                if (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == n or s[end] != s[end - q]):
                    found[d][start, end] = min(q, found[d].get((start, end), q))
        mid = (lo + hi) // 2
        doc, lo, hi = np.concatenate([doc, doc]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
        large = hi - lo >= LEAST
        doc, lo, hi = doc[large], lo[large], hi[large]
    return [sorted((s, e - s, q) for (s, e), q in f.items()) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay: those in no run, and the first period of the runs that no other run drops."""
    out, at = [], 0
    for start, length, period in sorted(runs, key=lambda r: (r[0] + r[2], r[1])):
        if start + period > at:
            out += words[at : start + period]
        at = max(at, start + length)
    return out + words[at:]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; of equal ones the first, then the one of the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _searched(batches: Iterator[pd.DataFrame], change: Callable[[int | None, list[bytes]], list[bytes]] | None, finish: Callable) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows: list[tuple] = []
        pending: list[tuple] = []
        total = 0
        for key, text in zip(b["doc_id"], b["text"]):
            words = (text or b"").split()
            key = None if pd.isna(key) else int(key)
            pending.append((key, change(key, words) if change else words))
            total += len(words)
            if total >= BLOCK:
                rows += [finish(k, w, r) for (k, w), r in zip(pending, runs_of([w for _, w in pending]))]
                pending, total = [], 0
        rows += [finish(k, w, r) for (k, w), r in zip(pending, runs_of([w for _, w in pending]))]
        yield pd.DataFrame(rows, columns=finish.columns, dtype=object)


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = strongest(runs)
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, its runs (start, length, period: words counted from 0), and the text without their repetitions."""

    def finish(key, words, runs):
        return key, [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(collapsed(words, runs)).decode("utf-8", "replace")

    finish.columns = ["doc_id", "runs", "text"]
    return _texts(docs).mapInPandas(lambda batches: _searched(batches, None, finish), "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's test rows: every tenth id, by checksum, gets a periodic tail."""
    n = len(words)
    h = crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the strongest one, and digests of all runs and of the collapsed words."""

    def finish(key, words, runs):
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return key, *_summary(words, runs), sha256(lines.encode()).hexdigest(), sha256(b" ".join(collapsed(words, runs))).hexdigest()

    finish.columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return _texts(docs).mapInPandas(lambda batches: _searched(batches, planted, finish), f"doc_id long, {FOUND}, runs_sha256 string, collapsed_sha256 string")
