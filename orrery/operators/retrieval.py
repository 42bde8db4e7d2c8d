"""Exact vector search, re-ranking, chunking and context budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def search(store: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0, max_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top-k of a stated query set against all rows, filters before the search.

    store: (id, v); queries: (query_id, q), sent to the tasks in blocks of at most `max_queries`. Each task keeps only its own
    k best per query before the shuffle, so what is shuffled doesn't grow with the store but with tasks x queries x k.
    """
    n = queries.count()
    blocks = max(1, -(-n // max_queries))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        local = nearest(store.select("id", "v"), numbered.where(F.col("block") == b), k)
        out = local if out is None else out.unionByName(local)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(store: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query_id, id, score): each task's k best per query, rows (id, v) against queries (query_id, q), which the driver hands
    to all tasks; with `by`, only rows and queries that are equal in it meet. Vectors that are null, zero or hold nulls, and
    those of another length, score 0."""
    # Vectors with a null in them go as null: pandas would make NaN of it.
    doubles = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.transform(c, lambda x: x.cast("double")))
    named = queries.select("query_id", doubles("q").alias("q"), (F.col(by) if by else F.lit(0)).alias("by"))
    asked: dict = {}
    for r in named.collect():
        asked.setdefault(r.by, []).append((r.query_id, r.q))
    shared = store.sparkSession.sparkContext.broadcast({g: (np.array([i for i, _ in rows], np.int64), _by_length([q for _, q in rows])) for g, rows in asked.items()})
    rows = store.select("id", doubles("v").alias("v"), (F.col(by) if by else F.lit(0)).alias("by"))
    return rows.mapInArrow(lambda batches: _best((b.to_pandas() for b in batches), shared.value, k), "query_id long, id long, score double")


def _by_length(vectors: list) -> dict:
    """{length: (places, matrix, norms)} of the vectors; those that are null have length 0."""
    size = np.array([0 if v is None else len(v) for v in vectors], np.int64)
    found = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        m = np.array([vectors[i] for i in at], np.float64) if n else np.zeros((len(at), 0))
        found[n] = (at, m, np.sqrt(_sums(m, m)))
    return found


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products by row, added up in the order of places, as Spark and SQL do."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


#: Rows that are scored at once, times queries.
CELLS = 4_000_000


def _best(batches: Iterator[pd.DataFrame], asked: dict, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows per query. Products of matrices tell which rows may be among them; only those are scored in the order of places."""
    kept: dict = {}
    # Beyond any difference of the two ways to add up, for cosines.
    slack = 1e-9
    for batch in batches:
        for g, rows in batch.groupby("by", sort=False):
            if g not in asked:
                continue
            names, queries = asked[g]
            ids = rows["id"].to_numpy(np.int64)
            state = kept.setdefault(g, _State(names, k))
            for n, (at, m, norms) in _by_length(list(rows["v"])).items():
                if n and n in queries:
                    qat, q, qn = queries[n]
                    unit = q / np.where(qn > 0, qn, 1)[:, None]
                    step = max(1, CELLS // len(q))
                    for low in range(0, len(m), step):
                        part, pn = m[low : low + step], norms[low : low + step]
                        close = unit @ (part / np.where(pn > 0, pn, 1)[:, None]).T
                        close[np.isnan(close)] = np.inf
                        if not state.full and len(part) > k:
                            state.floor[qat] = np.maximum(state.floor[qat], np.partition(close, len(part) - k, axis=1)[:, len(part) - k] - slack)
                        i, j = np.nonzero(close >= state.floor[qat][:, None])
                        size_ij = qn[i] * pn[j]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            score = np.where(size_ij == 0, 0.0, _sums(part[j], q[i]) / size_ij)
                        state.add(qat[i], ids[at[low + j]], score)
                unlike = np.arange(len(names))
                state.zeros(np.setdiff1d(unlike, queries[n][0]) if n and n in queries else unlike, ids[at])
    for state in kept.values():
        state.settle()
        # Not by way of pandas, where NaN is null.
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (state.names[state.query], state.id, state.score)], ["query_id", "id", "score"])


class _State:
    """The best rows per query so far, and a score that a further one must reach."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k, self.full = names, k, False
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(names), -np.inf)
        self.more: list = []
        self.held = 0

    def add(self, query: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.more.append((query, id, score))
            self.held += len(query)
            if self.held > max(100_000, len(self.names) * self.k):
                self.settle()

    def zeros(self, query: np.ndarray, id: np.ndarray) -> None:
        """Rows of score 0 for these queries; of so many equal ones the k least ids do."""
        if len(query) and len(id):
            id = np.sort(id)[: self.k]
            self.add(np.repeat(query, len(id)), np.tile(id, len(query)), np.zeros(len(query) * len(id)))

    def settle(self) -> None:
        if not self.more:
            return
        query, id, score = (np.concatenate(x) for x in zip((self.query, self.id, self.score), *self.more))
        self.more, self.held = [], 0
        rank = np.where(np.isnan(score), np.inf, score)  # NaN comes first, as in Spark
        order = np.lexsort((id, -rank, query))
        query, id, score, rank = query[order], id[order], score[order], rank[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], rank[last] - 1e-9)
        top = place < self.k
        self.query, self.id, self.score = query[top], id[top], score[top]
        self.full = True


def coherence(store: DataFrame, by: str) -> DataFrame:
    """Mean pairwise cosine of each group, 0.7 for groups of one: (|sum of unit vectors|^2 - n) / n(n - 1), without pairs."""
    unit = store.select(by, F.posexplode(F.transform("v", lambda x: x.cast("double") / norm(F.col("v")))).alias("i", "x"))
    g = unit.groupBy(by, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    return g.select(by, "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))).otherwise(0.7).alias("coherence"))


def rerank(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Hits with a weighted sum of score columns, ranked again."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.coalesce(F.col(c), F.lit(0.0))
    return hits.withColumn("relevance", F.round(total, 9)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")))


def token_budget(ranked: DataFrame, budget: int, most: int, by: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """The longest prefix of each ranking whose tokens fit the budget, at most `most` items; it stops at the first overflow."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(tokens).over(w)).where((F.col("used") <= budget) & (F.col("rank") <= most))


def chunk(docs: DataFrame, size: int = 512, overlap: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk_index, char_start, chunk) of fixed windows with overlap; empty texts have none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where(F.length(text) > 0).select(id, F.posexplode(starts).alias("chunk_index", "char_start"), text).select(id, "chunk_index", "char_start", F.substring(F.col(text), F.col("char_start") + 1, F.lit(size)).alias("chunk"))


def sections(docs: DataFrame, heading: str = "(?m)^(?=ITEM\\s+[0-9]+[A-Z]?\\.)", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section_index, title, section): split before headings where there are three or more, else the whole text."""
    parts = F.filter(F.split(text, heading), lambda s: F.trim(s) != "")
    found = F.size(F.filter(parts, lambda s: s.rlike("^ITEM\\s+[0-9]+[A-Z]?\\.")))
    d = docs.select(id, F.posexplode(F.when(found >= 3, parts).otherwise(F.array(text))).alias("section_index", "section"))
    return d.withColumn("title", F.regexp_extract("section", "^(ITEM\\s+[0-9]+[A-Z]?)\\.", 1))


def diverse(ranked: DataFrame, k: int = 50) -> DataFrame:
    """Greedy order by half relevance, half novelty of kind and source, per query (bounded candidates per query)."""
    def pick(g: pd.DataFrame) -> pd.DataFrame:
        left, kinds, sources, out = g.sort_values(["rank"]).to_dict("records"), set(), set(), []
        while left and len(out) < k:
            best = max(left, key=lambda r: (0.5 * r["score"] + 0.25 * ((r["kind"] not in kinds) + (r["source"] not in sources)), -r["rank"]))
            left.remove(best)
            kinds.add(best["kind"]), sources.add(best["source"])
            out.append((best["query_id"], best["id"], len(out) + 1))
        return pd.DataFrame(out, columns=["query_id", "id", "position"])

    return ranked.where(F.col("rank") <= 10 * k).groupBy("query_id").applyInPandas(pick, "query_id long, id long, position long")
