"""Quality rules as a ledger: every rule is evaluated once per document into a bit, with its measurements beside it.

A policy is a named, versioned set of bits that reject. Policies, and ablations of their rules, are answered from the
ledger alone: `apply_policy` masks the stored bits, `ablate` first counts documents by bit pattern (at most 2^rules
rows) and then combines those counts with bitwise operations, so no text is read again.

All expressions are built-in; repeats of 3-word windows are found inside each row by sorting window hashes, so a
document never leaves its task.

Defined results: null and blank texts have no words, zero in every measurement and fail `few_words`; repeated rows are
judged each on their own; an empty table gives an empty ledger; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WHITE, has_word, words_of

SYMBOLS = "#*$%&|<>"
#: Low bits of a sort key that hold a word position; longer documents sort structs instead.
POSITION_BITS = 20

#: The bit of each rule and when it fails, over the ledger's measurements.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words and n_words > 0"),
    "duplicate_lines": (3, "100 * n_dup_lines > 30 * n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
}
BASE = 0b11
#: Policy name and version -> the bits that reject.
POLICIES: dict[str, int] = {"base@1": BASE, "web@1": 0b111111, "web@2": 0b001111}
PRODUCTION = "web@1"


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, a long with bit b set if the rule of bit b fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select(
        "doc_id",
        words_of(F.col("text")).alias("w"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
    )
    d = d.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("w").alias("n"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.expr("array()").cast("array<long>")).otherwise(F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")).alias("h"),
    )
    d = d.withColumn("different", F.size(F.array_distinct("h")))
    d = d.withColumn("at", _repeated_windows())
    d = d.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _covered().cast("long").alias("n_repeat_words"), "n_lines")
    bits = [F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, fails in RULES.values()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return d.withColumn("failed", failed)


def _repeated_windows() -> Column:
    """Ascending positions of the windows whose hash occurs twice or more in `h`."""
    low = (1 << POSITION_BITS) - 1
    packed = f"sort_array(transform(h, (x, i) -> (shiftleft(shiftright(x, {POSITION_BITS}), {POSITION_BITS}) | cast(i as bigint))))"
    fast = f"""
        transform(array(struct({packed} as s)), r -> sort_array(transform(
            filter(r.s, (x, i) -> (i > 0 and shiftright(r.s[i - 1], {POSITION_BITS}) = shiftright(x, {POSITION_BITS}))
                or (i < size(r.s) - 1 and shiftright(r.s[i + 1], {POSITION_BITS}) = shiftright(x, {POSITION_BITS}))),
            x -> x & {low}L)))[0]"""
    exact = """
        transform(array(struct(sort_array(transform(h, (x, i) -> struct(x as x, cast(i as bigint) as i))) as s)), r -> sort_array(transform(
            filter(r.s, (y, i) -> (i > 0 and r.s[i - 1].x = y.x) or (i < size(r.s) - 1 and r.s[i + 1].x = y.x)),
            y -> y.i)))[0]"""
    none = F.expr("cast(array() as array<bigint>)")
    return (
        F.when(F.col("different") == F.size("h"), none)
        .when((F.size("h") < low) & (F.expr(f"size(array_distinct(transform(h, x -> shiftright(x, {POSITION_BITS}))))") == F.col("different")), F.expr(fast))
        .otherwise(F.expr(exact))
    )


def _covered() -> Column:
    """Words in the windows that start at `at`."""
    return F.when(F.size("at") == 0, F.lit(0)).otherwise(
        F.expr("3 + coalesce(aggregate(transform(at, (p, i) -> if(i = 0, 0L, least(3L, p - at[i - 1]))), 0L, (a, x) -> a + x), 0L)")
    )


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with base_failed and the policy's verdict `kept`; no rule is evaluated again."""
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    rejected = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected)


def patterns(rows: DataFrame) -> DataFrame:
    """Documents by bit pattern: at most 2^rules rows, whatever the corpus."""
    return rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def ablate(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents it fails, fails alone, and those kept if the rule were dropped."""
    mask = POLICIES[policy]
    by = patterns(rows)
    one = [(name, 1 << bit) for name, (bit, _) in RULES.items() if mask >> bit & 1]
    stack = ", ".join(f"'{name}', {value}L" for name, value in one)
    f = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    rest = f.bitwiseAND(F.bitwise_not(F.col("bit")))
    return (
        by.select("failed", "n", F.expr(f"stack({len(one)}, {stack}) as (rule, bit)"))
        .groupBy("rule")
        .agg(
            F.sum(F.when(f.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(f == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def judge(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed"]
    return apply_policy(ledger(docs), policy).select(*cols)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM p),
q AS (SELECT rid, count(DISTINCT x) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS x FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(q.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
      FROM w LEFT JOIN q ON w.rid = q.rid),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
              | CASE WHEN 10 * n_symbols > n_words AND n_words > 0 THEN 4 ELSE 0 END | CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
              | CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END | CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, n_lines, failed FROM f
"""
