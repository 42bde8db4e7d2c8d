"""Secret scan with built-in expressions only.

Base kinds are patterns with fixed rules (assignments, access keys, long hex runs). The method adds `random` spans:
runs of 20 key characters or more, which pass as random strings of their own encoding. Every run is tested.

Per candidate the encoding is inferred from its characters (hex, base32, base36, base62, base64), and three tests ask
whether it could be a uniform draw from that alphabet:
  chi-squared of character-class counts against the alphabet's shares (upper, lower, digit, other),
    together with repeated characters against their expectation;
  Wald-Wolfowitz runs of values above and below the middle of the alphabet;
  lag-one serial correlation of the values.
The smallest p-value times three (Bonferroni) is the candidate's p. Natural words, paths and repeated fillers fail.
Within each stratum of encoding and length class, Benjamini-Hochberg at ALPHA picks the candidates that are *not*
random; the rest stay as secrets. Long candidates so get no stricter bar for being long, and short ones, whose tests
have little power, are judged among their like. The p-values are counted on a fixed log grid first (at most strata x
GRID rows reach the driver), so no global sort is needed; thresholds are those of the grid, rounded against dropping.

Positions are code points, end exclusive. Java has no match positions in SQL: a text is split at its matches, and the
lengths of pieces and matches add up to positions.

Defined results: null and empty texts have no spans and the hash of the empty string; repeated rows are scanned each
on their own; equal starts are ordered by kind (assign, access, hex, random); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Staging

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
ALPHA = 0.05
#: p-values are counted in bins of a quarter decade from 1 down to 1e-15.
GRID, STEPS = 60, 4.0
LENGTHS = (28, 40, 64)
#: Encoding -> size of its alphabet.
SIZES = {"hex": 16.0, "base32": 32.0, "base36": 36.0, "base62": 62.0, "base64": 64.0}
STRATA = [(e, k) for e in SIZES for k in range(len(LENGTHS) + 1)]
SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _matches(pattern: str, group: int | None = None) -> Column:
    """array<struct<start, m, g>>: leftmost non-overlapping matches with their starts in code points."""
    full = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else full
    packed = F.array(F.struct(full.alias("m"), part.alias("g"), F.split("text", pattern, -1).alias("p")))
    return F.transform(
        packed,
        lambda r: F.aggregate(
            F.sequence(F.lit(0), F.size(r["m"]) - 1),
            F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,m:string,g:string>>)").alias("out")),
            lambda acc, i: F.struct(
                (acc["at"] + F.length(F.get(r["p"], i)) + F.length(F.get(r["m"], i))).cast("long").alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(F.get(r["p"], i))).cast("long").alias("start"), F.get(r["m"], i).alias("m"), F.get(r["g"], i).alias("g")))).alias("out"),
            ),
        )["out"],
    )[0]


def _spans(pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    found = F.filter(_matches(pattern, group), lambda x: F.length(x["g"]) >= least)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).cast("long").alias("stop")))
    return F.when(F.col("text").rlike(pattern), spans.cast(SPAN)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _candidates() -> Column:
    """array<struct<start, stop, s>>: runs that may be keys."""
    kind = "array<struct<start:bigint,stop:bigint,s:string>>"
    out = F.transform(_matches(CANDIDATE), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).cast("long").alias("stop"), x["m"].alias("s")))
    may = F.col("text").rlike("[A-Za-z0-9+/_-]{20}")
    return F.when(may, out.cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))


def _tail(z: str) -> str:
    """Two-sided normal tail of |z| (Abramowitz and Stegun 26.2.17)."""
    t = f"(1e0 / (1e0 + 0.2316419e0 * abs({z})))"
    poly = f"{t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))"
    return f"least(1e0, 2e0 * 0.3989422804014327e0 * exp(-0.5e0 * {z} * {z}) * ({poly}))"


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, stratum and p to rows with a string column `s` of at least 20 key characters."""
    values = "transform(split(s, ''), c -> cast(case when c between '0' and '9' then ascii(c) - 48 when encoding in ('hex', 'base36') then ascii(lower(c)) - 87 when encoding = 'base32' then if(c between '2' and '7', ascii(c) - 24, ascii(c) - 65) when c between 'a' and 'z' then ascii(c) - 87 when c between 'A' and 'Z' then ascii(c) - 29 when c in ('+', '-') then 62 else 63 end as double))"
    c = candidates.withColumn(
        "encoding",
        F.expr("case when s rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when s rlike '^[A-Z2-7]+$' then 'base32' when s rlike '^([0-9a-z]+|[0-9A-Z]+)$' then 'base36' when s rlike '^[0-9A-Za-z]+$' then 'base62' else 'base64' end"),
    )
    c = c.withColumn("k", F.element_at(F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv]), F.col("encoding")))
    c = c.withColumn("n", F.length("s").cast("double")).withColumn("v", F.expr(values))
    c = c.withColumn("digits", F.length(F.regexp_replace("s", "[^0-9]", "")).cast("double")).withColumn("lower", F.length(F.regexp_replace("s", "[^a-z]", "")).cast("double")).withColumn("upper", F.length(F.regexp_replace("s", "[^A-Z]", "")).cast("double"))
    # Shares of the classes under uniformity; in one-case alphabets the letters are one class.
    c = c.withColumn("pd", F.expr("case encoding when 'base32' then 6e0 else 10e0 end / k"))
    c = c.withColumn("pu", F.expr("if(encoding in ('base62', 'base64'), 26e0 / k, 0e0)"))
    two = "(digits - n * pd) * (digits - n * pd) / (n * pd) + (n - digits - n * (1e0 - pd)) * (n - digits - n * (1e0 - pd)) / (n * (1e0 - pd))"
    four = "(digits - n * pd) * (digits - n * pd) / (n * pd) + (lower - n * pu) * (lower - n * pu) / (n * pu) + (upper - n * pu) * (upper - n * pu) / (n * pu) + if(encoding = 'base64', (n - digits - lower - upper - n * 2e0 / k) * (n - digits - lower - upper - n * 2e0 / k) / (n * 2e0 / k), 0e0)"
    c = c.withColumn("x2", F.when(F.col("pu") > 0, F.expr(four.replace("(n * pu)", "(n * greatest(pu, 1e-9))"))).otherwise(F.expr(two)))
    c = c.withColumn("df", F.expr("case encoding when 'base62' then 2e0 when 'base64' then 3e0 else 1e0 end"))
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    c = c.withColumn("z_chi", F.expr("greatest(0e0, (power(x2 / df, 1e0 / 3e0) - (1e0 - 2e0 / (9e0 * df))) / sqrt(2e0 / (9e0 * df)))"))
    # Pairs of equal characters: n(n-1)/2k expected, nearly Poisson.
    c = c.withColumn("pairs", F.expr("aggregate(transform(array_distinct(v), a -> cast(size(filter(v, b -> b = a)) as double)), 0e0, (t, m) -> t + m * (m - 1e0) / 2e0)"))
    c = c.withColumn("z_pairs", F.expr("greatest(0e0, (pairs - n * (n - 1e0) / (2e0 * k)) / sqrt(n * (n - 1e0) / (2e0 * k)))"))
    c = c.withColumn("above", F.expr("cast(size(filter(v, a -> a >= k / 2e0)) as double)"))
    c = c.withColumn("runs", F.expr("1e0 + size(filter(v, (a, i) -> i > 0 and (a >= k / 2e0) <> (v[greatest(i - 1, 0)] >= k / 2e0)))"))
    c = c.withColumn("mu", F.expr("1e0 + 2e0 * above * (n - above) / n"))
    c = c.withColumn("z_runs", F.expr("if(above = 0 or above = n, 9e0, abs(runs - mu) / sqrt(greatest((mu - 1e0) * (mu - 2e0) / (n - 1e0), 1e-9)))"))
    c = c.withColumn("m", F.expr("aggregate(v, 0e0, (t, a) -> t + a) / n"))
    c = c.withColumn("ss", F.expr("aggregate(v, 0e0, (t, a) -> t + (a - m) * (a - m))"))
    c = c.withColumn("z_serial", F.expr("if(ss = 0, 9e0, abs(aggregate(transform(v, (a, i) -> if(i = 0, 0e0, (a - m) * (v[greatest(i - 1, 0)] - m))), 0e0, (t, a) -> t + a) / ss * sqrt(n) + 1e0 / sqrt(n)))"))
    p = F.least(F.lit(1.0), 4 * F.least(F.expr(_tail("z_chi")), F.expr(_tail("z_pairs")), F.expr(_tail("z_runs")), F.expr(_tail("z_serial"))))
    c = c.withColumn("p", p)
    length = F.lit(0)
    for bound in LENGTHS:
        length = length + (F.col("n") >= bound).cast("int")
    code = F.element_at(F.create_map(*[x for i, e in enumerate(SIZES) for x in (F.lit(e), F.lit(i))]), F.col("encoding"))
    c = c.withColumn("stratum", (code * (len(LENGTHS) + 1) + length).cast("int"))
    return c.withColumn("bin", F.least(F.lit(GRID), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-16))) * STEPS)).cast("int"))


def thresholds(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """Per stratum the least bin that Benjamini-Hochberg rejects; counts: (stratum, bin, n) rows, at most strata x (GRID + 1).

    All of a bin counts as its largest p-value, so a bin is rejected only if every candidate in it would be.
    """
    out = {}
    for s in {c[0] for c in counts}:
        mine = sorted(((b, n) for t, b, n in counts if t == s), reverse=True)
        total, seen, least = sum(n for _, n in mine), 0, GRID + 1
        for b, n in mine:  # from the smallest p-values on
            seen += n
            if 10 ** (-b / STEPS) <= ALPHA * seen / total:
                least = b
        out[s] = least
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("doc_id", F.concat(_spans(ASSIGN, 0, 2, 6), _spans(ACCESS, 1), _spans(HEX, 2)).alias("base"), _candidates().alias("found"))
    # What a base span covers needs no second finding.
    d = d.withColumn("found", F.filter("found", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))))
    stage = Staging(spark, "secrets")
    scanned = stage.keep(d)
    tested = battery(scanned.where(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.s").distinct()).select("s", "stratum", "bin")
    tested = stage.keep(tested)
    counts = [(r[0], r[1], r[2]) for r in tested.groupBy("stratum", "bin").count().collect()]  # at most strata x (GRID + 1) rows
    limits = thresholds(counts)
    drop = F.lit(False)
    for s, least in limits.items():
        drop = drop | ((F.col("stratum") == s) & (F.col("bin") >= least))
    # Only documents with candidates take part in the join; all others pass by.
    random = (
        scanned.where(F.size("found") > 0)
        .select("doc_id", F.xxhash64("base", "found").alias("row"), F.explode("found").alias("c"))
        .join(tested.where(~drop).select(F.col("s").alias("secret")), F.col("c.s") == F.col("secret"), "left_semi")
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct(F.col("c.start").alias("start"), F.lit(3).alias("kind"), F.col("c.stop").alias("stop"))).alias("random"))
    )
    keyed = scanned.where(F.size("found") > 0).withColumn("row", F.xxhash64("base", "found"))
    with_random = keyed.join(random.select(F.col("doc_id").alias("id2"), F.col("row").alias("row2"), "random"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left").select("doc_id", "base", "random")
    return digest(with_random.unionByName(scanned.where(F.size("found") == 0).select("doc_id", "base", F.lit(None).cast(SPAN).alias("random"))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(rows: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    every = F.concat(F.col("base"), F.coalesce(F.col("random"), F.expr(f"cast(array() as {SPAN})")))
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )
