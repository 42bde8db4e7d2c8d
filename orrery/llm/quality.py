"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured with built-in expressions. Each is cut into at most BINS bins at quantiles of the training rows.
Training is cyclic boosting on the logistic loss: round after round, every feature in turn gets a shallow tree over its
bins (LEAVES leaves by exact search for the best cuts), whose small step is added to the feature's lookup table. The
strongest pairs are then found on a coarse grid by the loss they still explain, and get trees that cut both features
once, added to two-dimensional tables. A score is the sum of table entries at a row's bins, through the logistic
function, so scoring is array look-ups and additions.

Training takes at most SAMPLE labelled rows: those with the smallest hashes of doc_id, so the same rows at every run and
every partitioning. Their ids (at most SAMPLE) are broadcast to pick their texts. All documents are scored.

Defined results: null and empty texts have all counts zero and are scored like any text; rows with a null doc_id are
scored and not held out; of several labels of a document the smaller quality counts, null labels are ignored; with no
labels, or labels of one kind only, every score is the (smoothed) share of ones, 0.5 without any; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WHITE, bounded_batches, words_of

SAMPLE = 20_000
BINS, LEAVES, ROUNDS, RATE = 64, 3, 300, 0.08
PAIRS, COARSE, PAIR_ROUNDS, LEAST = 6, 8, 100, 5.0
CUT = 0.3



def _log(a: str) -> Callable[[Column], Column]:
    return lambda m: F.log1p(m[a])


def _share(a: str, b: str) -> Callable[[Column], Column]:
    return lambda m: m[a] / F.greatest(m[b], F.lit(1.0))


#: Feature name -> its value from the counts of `measures`.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "log_chars": _log("chars"),
    "log_words": _log("words"),
    "word_length": _share("word_chars", "words"),
    "symbols_per_word": _share("symbols", "words"),
    "bangs_per_word": _share("bangs", "words"),
    "pipes_per_word": _share("pipes", "words"),
    "upper_share": _share("upper", "word_chars"),
    "lower_share": _share("lower", "word_chars"),
    "digit_share": _share("digits", "word_chars"),
    "stops_per_word": _share("stops", "words"),
    "marks_per_word": _share("marks", "words"),
    "words_per_line": _share("words", "lines"),
    "distinct_words": _share("distinct_words", "words"),
    "distinct_lines": _share("distinct_lines", "lines"),
    "repeats_in_a_row": _share("repeats", "words"),
}
#: Character counts: the characters of each.
COUNTED = {
    "symbols": "#*$%&|<>",
    "bangs": "!",
    "pipes": "|",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    "lower": "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß",
    "digits": "0123456789",
    "stops": ".",
    "marks": ",;:?\"'()[]{}/\\@=_-",
}
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"


def measures(text: Column) -> Column:
    """The features of a text as a struct of doubles. Words and lines are bound once, so no plan splits a text again."""
    bound = F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("t"), words_of(t).alias("w"), F.split(t, "\n").alias("ls")))

    def counts(r: Column) -> Column:
        t, w, ls = r["t"], r["w"], r["ls"]
        found = {
            "chars": F.length(t),
            "word_chars": F.length(F.translate(t, WHITE, "")),
            "words": F.size(w),
            "distinct_words": F.size(F.array_distinct(w)),
            "lines": F.size(ls),
            "distinct_lines": F.size(F.array_distinct(ls)),
            "repeats": F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))),
        }
        found |= {name: F.length(t) - F.length(F.translate(t, chars, "")) for name, chars in COUNTED.items()}
        return F.struct(*[c.cast("double").alias(name) for name, c in found.items()])

    return F.transform(F.transform(bound, counts), lambda m: F.struct(*[f(m).alias(name) for name, f in FEATURES.items()]))[0]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features, as doubles."""
    return docs.select("doc_id", measures(F.col("text")).alias("f")).select("doc_id", "f.*")


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], side="right")]
        for (i, j), (e, f), t in zip(self.pairs, self.pair_edges, self.pair_tables):
            total += t[np.searchsorted(e, x[:, i], side="right"), np.searchsorted(f, x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
    return q[q > values.min()]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values over bins with gradients g and curvatures h: best cuts, one after the other."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            gain[(ch[:-1] < LEAST / 4) | (ch[-1] - ch[:-1] < LEAST / 4)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (p, a + k + 1))
        if best[1] is None:
            break
        p, cut = best[1]
        a, b = parts[p]
        parts[p : p + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid: its gain and the four leaves as a table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    a, b = cg[: n - 1, : m - 1], ch[: n - 1, : m - 1]
    top, left, topb, leftb = cg[: n - 1, -1:], cg[-1:, : m - 1], ch[: n - 1, -1:], ch[-1:, : m - 1]
    quarters = [(a, b), (top - a, topb - b), (left - a, leftb - b), (cg[-1, -1] - top - left + a, ch[-1, -1] - topb - leftb + b)]
    gain = sum(_gain(x, y) for x, y in quarters) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, n)):
        for cols in (slice(0, j + 1), slice(j + 1, m)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    total = np.full(len(y), model.base)
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]

    def grads() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            n = len(model.tables[k])
            if n < 2:
                continue
            g, h = grads()
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES)
            model.tables[k] += step
            total += step[b]
    coarse = [_edges(x[:, k], COARSE) for k in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(coarse[i]) + 1, len(coarse[j]) + 1
        g, h = grads()
        at = small[i] * m + small[j]
        return np.bincount(at, g, n * m).reshape(n, m), np.bincount(at, h, n * m).reshape(n, m)

    able = [k for k, e in enumerate(coarse) if len(e)]
    ranked = sorted(((_quadrants(*grid(i, j))[0], i, j) for p, i in enumerate(able) for j in able[p + 1 :]), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_edges = [(coarse[i], coarse[j]) for i, j in model.pairs]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * _quadrants(*grid(i, j))[1]
            model.pair_tables[k] += step
            total += step[small[i], small[j]]
    # Each table is centred; the base takes up what it loses, so scores stay.
    for k, b in enumerate(bins):
        mean = float(model.tables[k][b].mean())
        model.tables[k] -= mean
        model.base += mean
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns labels.quality from at most `sample` labelled rows that are not held out."""
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(f"not {HELD_OUT}").withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample).select(F.col("doc_id").alias("labelled"), "quality")
    picked = F.broadcast(known)  # at most `sample` rows
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("labelled"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    f = features(rows).join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).select("doc_id", "quality", *FEATURES).toPandas()
    f = f.sort_values("doc_id")
    return fit(f[list(FEATURES)].to_numpy(np.float64), (f["quality"] > 0).to_numpy(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    names = list(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(b[names].to_numpy(np.float64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= CUT).astype(np.int32)})

    return features(docs).withColumn("held_out", F.expr(HELD_OUT)).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, with all their columns, which pass by as Arrow batches."""
    model, names = train(docs, labels, sample), docs.columns
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("f")
            x = np.stack([f.field(name).to_numpy(zero_copy_only=False) for name in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(model.score(x) >= CUT))], ["row"])

    # The row as one column: names of the documents clash with none of ours.
    rows = docs.select(F.struct(*names).alias("row"), measures(F.col("text")).alias("f"))
    return rows.mapInArrow(run, rows.select("row").schema).select(*[F.col("row")[c].alias(c) for c in names])
