"""Phrase collocations: weighted n-grams of distinct pieces, counted in duckdb per hash bucket, scored by their weakest cut.

Texts are split at punctuation and line ends into pieces. Identical pieces of a language collapse to one with a
multiplicity, in partial sums before the shuffle. Phrases of 1, 2, ... LONGEST words are counted length by length over the
distinct pieces: tasks sum up what they hold, ship (lang, phrase, weight) to the bucket of its hash, and there duckdb sums
each bucket out of core, keeping phrases that occur FREQUENT times. A phrase is counted only if both phrases of one word
less in it may be frequent: a bit table of fixed size, filled from the length before, tells. Two phrases on one bit only
mean that more is counted; counts go by the phrases themselves and are exact, whatever the size of the table. Once the
frequent pairs of words are known, pieces are cut down to the stretches of three words and more that such pairs cover;
all longer frequent phrases lie within these.

Each cut of a candidate into two parts asks for the parts' counts: requests are shuffled to where the counts are (joins on
language and part), as are the questions of shorter candidates whether a longer one occurs as often. Every part occurs at
least as often as the whole, so all counts asked for are there. A longer phrase that occurs as often as a candidate in it
makes each phrase between them occur as often too, so one word more is enough to look at.

Arithmetic is decimal with 38 digits. duckdb may use a scratch folder of its task, which nothing else reads and which is
gone when the task ends; a lost executor costs its running tasks, as the tables of each length are in the shared folder.

Defined results: null texts have no pieces; a null language is `und`; empty pieces are no pieces; repeated rows count each;
ties of score and count are ordered by phrase in UTF-8 byte order; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, Staging, bounded_batches

FREQUENT, LONGEST, TOP = 100, 5, 2000
BREAKS, BLANKS = "[.,;:!?\\x0A-\\x0D]", "[\\x20\\x09]+"
#: The characters of BREAKS.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: The length whose frequent phrases cut the pieces down.
NARROW = 2
#: Bits of the table that tells which phrases may be frequent, as a power of two (8 MB), and phrases a task holds at most
#: before it ships their sums.
TABLE, HELD = 26, 400_000
#: Of a task's duckdb.
MEMORY = "400MB"
COUNTS = "lang string, phrase binary, f long"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, words parted by single spaces, and how often they occur."""
    # Translated first, so that neither the cut nor most pieces need a pattern.
    text = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER + ENDS + "\t", LOWER + "\n" * len(ENDS) + " "), "\n")
    raw = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(text).alias("raw"))
    single = F.when(F.contains("raw", F.lit("  ")), F.regexp_replace("raw", " +", " ")).otherwise(F.col("raw"))
    clean = raw.select("lang", F.trim(single).alias("piece")).where("piece <> ''")
    return clean.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def places_of(words: list[bytes], langs: np.ndarray, k: int, size: int) -> np.ndarray:
    """The bits, in a table of 2^size, of the k words from each place on, within their language."""
    return _places(np.fromiter(map(crc32, words), np.uint64, len(words)), langs, k, size)


def _places(crc: np.ndarray, langs: np.ndarray, k: int, size: int) -> np.ndarray:
    h = langs.astype(np.uint64) + np.uint64(k)
    for j in range(k):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h[: len(crc) - j] += crc[j:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - size)).astype(np.int64)


def _often(langs: pa.Array, piece: np.ndarray, words: pa.Array, code: np.ndarray, k: int, table: np.ndarray) -> np.ndarray:
    """Whether the k words from each place on may be frequent."""
    names = langs.dictionary_encode()
    salts = np.array([crc32(n.encode()) for n in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
    crc = np.fromiter(map(crc32, words.to_pylist()), np.uint64, len(words))[code]
    bit = _places(crc, salts[piece], k, len(table).bit_length() + 2)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; of each word of the pieces: its code, its piece, and how many follow it there, itself included."""
    split = pc.split_pattern(texts, b" ")
    sizes = pc.list_value_length(split).to_numpy()
    coded = split.flatten().dictionary_encode()
    code, piece = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    return coded.dictionary, code, piece, np.cumsum(sizes)[piece] - np.arange(len(code))


def _grams(batches: Iterator[pa.RecordBatch], k: int, table: np.ndarray | None, most: int) -> Iterator[pa.RecordBatch]:
    """Sums (lang, phrase, w) of the phrases of k words; table: bits of the frequent phrases of k - 1 words."""

    def phrases(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        words, code, piece, left = _coded(texts)
        fit = left >= k
        if table is not None:
            often = _often(langs, piece, words, code, k - 1, table)
            fit &= often & np.append(often[1:], False)
        here = np.flatnonzero(fit)
        parts = [words.take(pa.array(code[here + j])) for j in range(k)]
        return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" "), piece[here]

    return _sums(batches, phrases, most)


def _stretches(batches: Iterator[pa.RecordBatch], k: int, table: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Sums (lang, piece, m) of the longest stretches of over k words in which all phrases of k words may be frequent."""

    def stretches(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        words, code, piece, left = _coded(texts)
        often = _often(langs, piece, words, code, k, table) & (left >= k)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
        first, sizes = edges[::2], edges[1::2] - edges[::2]
        first, sizes = first[sizes > 1], sizes[sizes > 1] + k - 1
        ends = np.cumsum(sizes)
        here = np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words.take(pa.array(code[here])))
        return pc.binary_join(lists, b" "), piece[first]

    for b in _sums(batches, stretches, most):
        yield pa.record_batch(b.columns, names=["lang", "piece", "m"])


def _sums(batches: Iterator[pa.RecordBatch], part: Callable[[pa.Array, pa.Array], tuple[pa.Array, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Sums (lang, phrase, w) of what `part` makes of pieces, and of which; of over `most` rows at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        langs, texts, m = (batch.column(c) for c in ("lang", "piece", "m"))
        if not len(texts):
            continue
        phrases, piece = part(langs, texts)
        at = pa.array(piece)
        held.append(_summed([pa.table({"lang": langs.take(at), "phrase": phrases, "w": m.take(at)})]))
        if sum(t.num_rows for t in held) > most:
            yield from _shipped(held)
            held = []
    if held:
        yield from _shipped(held)


def _summed(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("w", "sum")])
    return sums.select(["lang", "phrase", "w_sum"]).rename_columns(["lang", "phrase", "w"])


def _shipped(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The sums, language by language, so that they pack well."""
    sums = _summed(tables)
    for lang in pc.unique(sums["lang"]):
        yield from sums.filter(pc.equal(sums["lang"], lang)).combine_chunks().to_batches(50_000)


def _counted(batches: Iterator[pa.RecordBatch], k: int, least: int, size: int) -> Iterator[pa.RecordBatch]:
    """A bucket's sums of at least that size, by duckdb; each with its bit for the next length."""
    import duckdb

    first = next(batches, None)
    if first is None:
        return

    def all_of() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch}) as con:
        con.register("sums", pa.RecordBatchReader.from_batches(first.schema, all_of()))
        found = con.sql(f"select lang, phrase, cast(sum(w) as bigint) as f from sums group by lang, phrase having sum(w) >= {least}").to_arrow_reader(50_000)
        for b in found:
            if not b.num_rows:
                continue
            phrases = b.column("phrase").to_pylist()
            salts = np.array([crc32(n.encode()) for n in b.column("lang").to_pylist()], np.uint64)
            words = b" ".join(phrases).split(b" ")
            bits = places_of(words, np.repeat(salts, k), k, size)[::k]
            yield pa.record_batch([b.column("lang"), b.column("phrase"), b.column("f"), pa.array(bits)], names=["lang", "phrase", "f", "bit"])


def _table(counts: DataFrame) -> np.ndarray:
    """The bits of the frequent phrases, or-ed together on the cluster: 2^TABLE bits, whatever their number."""
    words = counts.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (TABLE - 6), np.int64)
    rows = words.toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def frequent(stage: Staging, distinct: DataFrame, least: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f, k): all phrases of up to `longest` words that occur `least` times."""
    spark, table, out = distinct.sparkSession, None, None
    size, most = TABLE, HELD
    source = distinct.select("lang", F.col("piece").cast("binary").alias("piece"), "m")
    for k in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(table)
        sums = source.mapInArrow(lambda b, k=k, t=shared: _grams(b, k, t.value, most), "lang string, phrase binary, w long")
        counts = sums.repartition("lang", "phrase").mapInArrow(lambda b, k=k: _counted(b, k, least, size), f"{COUNTS}, bit long")
        counts = stage.keep(counts)
        part = counts.select("lang", F.col("phrase").cast("string").alias("phrase"), "f", F.lit(k).alias("k"))
        out = part if out is None else out.unionByName(part)
        if k < longest:
            table = _table(counts)
        if k == NARROW and k < longest:
            cut = source.mapInArrow(lambda b, k=k, t=spark.sparkContext.broadcast(table): _stretches(b, k, t.value, most), "lang string, piece binary, m long")
            source = stage.keep(cut)
    return out


def collocations(docs: DataFrame, least: int = FREQUENT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    bounded_batches(docs.sparkSession, rows="50000")
    stage = Staging(docs.sparkSession, "phrases")
    distinct = stage.keep(pieces(docs))
    totals = distinct.groupBy("lang").agg(F.sum(F.col("m") * (F.length("piece") - F.length(F.translate("piece", " ", "")) + 1)).alias("n"))
    counts = frequent(stage, distinct, least, longest)
    whole = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "k")
    held = whole.where("k > 2").select("lang", F.explode(F.array(*[F.array_join(F.slice("w", i, F.col("k") - 1), " ") for i in (1, 2)])).alias("phrase"), F.col("a").alias("longer"))
    longest_of = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = whole.join(longest_of, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    heads, tails = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals) if totals.count() <= 1000 else totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(38, 0)) * n) div (cast(l as decimal(38, 0)) * r)")
    scored = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s"))
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("s.a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")


#: The same as SQL, with every phrase counted.
SQL = f"""WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '{BLANKS.replace(chr(92) * 2, chr(92))}'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS.replace(chr(92) * 2, chr(92))}')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1), g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k) GROUP BY 1, 2, 3 HAVING count(*) >= {FREQUENT}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1), longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, f FROM c WHERE k > 2) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR longer.f < c.f), cut AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT cut.lang, cut.phrase, cut.f AS a, j, h.f AS l, t.f AS r, n.n, ((1000::HUGEINT * cut.f * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score FROM cut JOIN n ON n.lang = cut.lang JOIN g h ON h.lang = cut.lang AND h.phrase = array_to_string(w[1:j], ' ') JOIN g t ON t.lang = cut.lang AND t.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1) SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}"""
