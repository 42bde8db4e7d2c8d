"""Near-duplicates of whole documents: MinHash signatures and a multi-index Hamming join, confirmed on full sets.

A document is the set of its distinct 5-word shingles (64-bit hashes). Documents with one and the same set form a class;
everything below works on classes, so exact copies cost nothing however many they are.

Signatures have CHUNKS x WIDTH minima of BITS bits each. By the pigeonhole principle two signatures that differ in at
most CHUNKS * (ERRORS + 1) - 1 places differ in at most ERRORS places of some chunk. With ERRORS = 1 a chunk is indexed
once per place left out, so both land under a common key: every pair under that distance is found, with WIDTH * CHUNKS
keys a class and no pairs enumerated yet. The number of chunks follows the similarity asked for, so that a pair at it
misses all keys with a chance below 1e-6: 8 chunks at 0.85, 11 at 0.80.

Links are found without emitting all pairs of a key (see links.py): under each key the classes are compared with one
pivot, first by signature distance, then on full sets, and confirmed links join components; what is left meets under the
rarest shingles by which it differs from its pivot. Copies that differ from one another too much to be linked share no
such shingle, however many they are. No partner or candidate is capped. Components come from rounds of minimum labels
with pointer jumping on tables in the shared folder; nothing of a document reaches the driver but counts.

A class is named by 128 bits of hash; within a pair, shingles are compared by 64 bits.

Defined results: null and blank texts have an empty set, are linked with nothing and kept; texts of 1 to 4 words are one
shingle, their whole sequence; rows with a null doc_id take part and are never kept if linked with a row that has an id,
else their component_id is null and they are kept; repeated rows with equal doc_id and text get equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, Staging, ascii_lower, bounded_batches, each_of, words_of
from orrery.llm.links import link

SHINGLE = 5
PERCENT = 85
WIDTH, BITS, SEED = 5, 16, 20_240_229


def chunks_for(percent: int) -> int:
    """The fewest chunks by which a pair of that similarity misses all keys with a chance below 1e-6."""
    s = percent / 100
    missed, n = 1 - s**WIDTH - WIDTH * (1 - s) * s ** (WIDTH - 1), 1
    while missed**n >= 1e-6:
        n += 1
    return n


def far_for(percent: int) -> int:
    """Pairs under a common key with more differing places are no candidates: at that similarity the chance is below 1e-7."""
    s, n = percent / 100, chunks_for(percent) * WIDTH
    far, tail = n, 0.0
    while far > 0 and tail + (more := comb(n, far) * (1 - s) ** far * s ** (n - far)) < 1e-7:
        far, tail = far - 1, tail + more
    return far


CHUNKS = chunks_for(PERCENT)
PLACES = CHUNKS * WIDTH
FAR = far_for(PERCENT)
#: Ids up to this number are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 2_000_000


def shingles(text: Column) -> Column:
    """Sorted distinct shingle hashes of a text."""
    w = words_of(ascii_lower(text))
    packed = F.array(F.struct(w.alias("w")))
    windows = F.transform(
        packed,
        lambda r: F.when(F.size(r["w"]) == 0, F.expr("cast(array() as array<bigint>)"))
        .when(F.size(r["w"]) < SHINGLE, F.array(F.xxhash64(F.lit("short"), F.array_join(r["w"], " "))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(r["w"]) - SHINGLE), lambda i: F.xxhash64(*[F.get(r["w"], i + k) for k in range(SHINGLE)]))),
    )[0]
    return F.sort_array(F.array_distinct(windows))


def _hashes(places: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, places, dtype=np.uint64)


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """b-bit minima of non-empty sets, one row each."""
    a, b = _hashes(places)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = np.concatenate(sets).astype(np.int64).view(np.uint64)
    x = x ^ (x >> np.uint64(31))
    out = np.empty((len(sets), places), np.int32)
    for k in range(places):
        h = x * a[k] + b[k]
        h ^= h >> np.uint64(29)
        least = np.minimum.reduceat(h * np.uint64(0xBF58476D1CE4E5B9), starts)
        out[:, k] = ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


def _sign(batches: Iterator[pd.DataFrame], places: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = b["n"].to_numpy()
        sig: list = [None] * len(b)
        full = np.flatnonzero(n > 0)
        # A bounded number of shingles at a time.
        for part in np.split(full, np.flatnonzero(np.diff(np.cumsum(n[full]) // 2_000_000)) + 1) if len(full) else []:
            for i, s in zip(part, signatures([b["s"].iloc[i] for i in part], places)):
                sig[i] = s
        yield pd.DataFrame({"doc_id": b["doc_id"], "t": b["t"], "n": n, "c1": b["c1"], "c2": b["c2"], "sig": sig})


def _keys(classes: DataFrame, chunks: int) -> DataFrame:
    """(key, c1, c2): per chunk one key for each place left out."""
    sig = F.col("sig")
    keys = [F.xxhash64(F.lit(c * WIDTH + e), *[sig[c * WIDTH + k] for k in range(WIDTH) if k != e]) for c in range(chunks) for e in range(WIDTH)]
    return each_of(classes.select("c1", "c2", F.array(*keys).alias("keys")), "keys", chunks * WIDTH, "key")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    stage = Staging(spark, "neardup")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sets = texts.select("doc_id", F.xxhash64("text").alias("t"), shingles(F.col("text")).alias("s"))
    # A set is told from others by 128 bits of hash; the text's hash only finds its row again under a doc_id.
    sets = sets.select("doc_id", "t", "s", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("c1"), F.xxhash64(F.lit(SEED), "s").alias("c2"))
    chunks = chunks_for(percent)
    signed = stage.keep(sets.mapInPandas(lambda batches: _sign(batches, chunks * WIDTH), "doc_id long, t long, n long, c1 long, c2 long, sig array<int>"))
    classes = stage.keep(signed.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "t")).alias("rep"), F.first("sig").alias("sig")))
    keys = _keys(classes, chunks)
    # Keys of two classes or more; that two classes under one key agree in c1 by chance is beyond all odds.
    common = keys.groupBy("key").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a < b").select("key")
    # Rows under keys of two classes or more; all that follows works on these.
    shared = stage.keep(keys.join(common, "key").select("key", _cid().alias("cid")))
    members = shared.select("cid").distinct()
    sigs = stage.keep(classes.withColumn("cid", _cid()).join(members, "cid", "left_semi").select("cid", "c1", "c2", "first", "rep", "sig"))
    full = stage.keep(_sets_of(texts, sigs))
    labels = link(stage, shared, sigs.select("cid"), lambda pairs: _confirmed(pairs, sigs, full, percent), lambda pairs: _differences(stage, pairs, full, percent), _room(percent))
    at = labels.join(sigs.select("cid", "c1", "c2", "first"), "cid")
    root = at.groupBy("label").agg(F.min("first").alias("component"))
    top = stage.keep(at.join(root, "label").select("c1", "c2", "component"))
    reached = stage.keep(classes.select("c1", "c2", "first").join(top, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("component", "first").alias("component")))
    stage.drop(shared, full, sigs, classes, labels, top)
    out = signed.join(reached, ["c1", "c2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _cid() -> Column:
    """A class by all its bits."""
    return F.concat(F.hex("c1"), F.lit(":"), F.hex("c2"))


def _sets_of(texts: DataFrame, sigs: DataFrame) -> DataFrame:
    """(cid, s, n): the full sets of classes, each from the text of its first document."""
    ids = sigs.select("cid", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("t"))
    if sigs.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("t"))).select("cid", "text")
    # Repeated rows: one text is enough.
    return rows.dropDuplicates(["cid"]).select("cid", shingles(F.col("text")).alias("s")).withColumn("n", F.size("s"))


def _differences(stage: Staging, pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(key, cid, n, d, at): the rarest shingles by which each class differs from its pivot, and their places in that order.

    With D = set xor pivot, the symmetric difference of two sets is that of their Ds. Sets of the asked-for similarity
    differ in at most (n_x + n_y)(1 - s) / (1 + s) shingles, fewer than n_x (1 - s) / s. What is not linked with the pivot
    has a D larger than that, so the Ds of a linked pair have shingles in common, all but the said number of each; by the
    prefix principle one of them is among as many and one of either's rarest.
    """
    fx, fp = full.select("cid", "n", "s"), full.select(F.col("cid").alias("pivot"), F.col("s").alias("ps"))
    apart = F.concat(F.array_except("s", "ps"), F.array_except("ps", "s"))
    both = stage.keep(pairs.join(fx, "cid").join(fp, "pivot").select("pivot", "cid", "n", apart.alias("apart")))
    each = both.select("pivot", "cid", "n", F.size("apart").alias("d"), F.explode("apart").alias("shingle"))
    several = each.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles of one class only come first in its order, but join nothing.
    own = each.join(several, ["pivot", "shingle"]).groupBy("pivot", "cid", "n", "d").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    first = F.col("d") - F.size("common")
    places = F.least(F.col("d"), F.floor(F.col("n") * F.lit(100 - percent) / percent).cast("int") + 1) - first
    rows = own.where(places > 0).select("pivot", "cid", "n", "d", first.alias("first"), F.posexplode(F.slice("common", F.lit(1), places)).alias("k", "c"))
    return rows.select(F.xxhash64("pivot", "c.shingle").alias("key"), "cid", "n", "d", (F.col("first") + F.col("k")).alias("at"))


def _room(percent: int) -> str:
    """What the first common difference of a pair must leave room for: so many common differences that the rest is small enough."""
    return f"{100 + percent}L * (d_x + d_y - 2 * least(d_x - at_x, d_y - at_y)) <= {100 - percent}L * (n_x + n_y)"


def _confirmed(pairs: DataFrame, sigs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union; signatures first, sets for the near ones."""
    sx = sigs.select(F.col("cid").alias("x"), F.col("sig").alias("sx"))
    sy = sigs.select(F.col("cid").alias("y"), F.col("sig").alias("sy"))
    near = pairs.join(sx, "x").join(sy, "y").where(F.expr(f"size(filter(zip_with(sx, sy, (p, q) -> p <> q), d -> d)) <= {far_for(percent)}")).select("x", "y")
    fx = full.select(F.col("cid").alias("x"), F.col("s").alias("ax"), F.col("n").alias("nx"))
    fy = full.select(F.col("cid").alias("y"), F.col("s").alias("ay"), F.col("n").alias("ny"))
    both = near.join(fx, "x").join(fy, "y").where(f"100L * least(nx, ny) >= {percent}L * greatest(nx, ny)")
    both = both.withColumn("common", F.size(F.array_intersect("ax", "ay")).cast("long"))
    return both.where(f"100L * common >= {percent}L * (nx + ny - common)").select("x", "y")


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of near-duplicates."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = Staging(docs.sparkSession, "gone").keep(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


#: The same as SQL, over all pairs with a common shingle.
SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN ['  ' || array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY 1), i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2), l AS MATERIALIZED (SELECT x, y FROM i JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y), c AS (SELECT r.x, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept FROM d JOIN c ON c.x = d.rid LEFT JOIN n ON n.rid = d.rid"""
