"""URL filter: block and allow rules on hosts and path prefixes as a sort-merge range join.

A host is keyed by its labels in reverse order, each ended by a dot, so `a.example.net` becomes `net.example.a.`.
A rule's host and all its subdomains then form one interval of keys, and the intervals of all rules nest or are apart.
Urls sorted by key are swept once against rules sorted by key; a stack holds the rules whose interval is open.
Among the open rules whose path starts the url's path, the longest (host and path) wins; of equally long ones a
longer host, then block.

Rules are handed to every task only up to `max_local_rules`, which is checked. Beyond, urls and rules are dealt to
key ranges together (a rule goes to each range that it overlaps), with hot ranges salted.

Defined results: null urls and urls without `://` have an empty host and path, meet no rule and are allowed; repeated
urls are judged alike, each row on its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
OUT = "page_id long, host string, path string, rule string, verdict string"
RULE_SCHEMA = "action string, host string, path string"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    """`a.example.net` -> `net.example.a.`"""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """The stack of open rules, moved along a sorted sequence of keys."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()):
        self.rules = sorted((key_of(h), h, p, a) for a, h, p in rules)
        self.next, self.stack, self.key = 0, [], None

    def open(self, key: str, host: str, path: str, action: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        self.stack.append((key, host, path, action))
        self.key = None

    def at(self, key: str) -> list[tuple[str, str, str, str]]:
        """The rules open at a key, the one that wins first; keys must come in ascending order."""
        if key != self.key:
            while self.next < len(self.rules) and self.rules[self.next][0] <= key:
                self.open(*self.rules[self.next])
                self.next += 1
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
            self.key = key
            self.active = sorted(self.stack, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[3] != "block"))
        return self.active

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        for _, host, start, action in self.at(key):
            if path.startswith(start):
                return host + start, action
        return None, "allow"


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]] = RULES, max_local_rules: int = 100_000, ranges: int = 256, salts: int = 16) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. rules: (action, host, path) rows."""
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", reversed_key(F.col("host")))
    if isinstance(rules, list):
        if len(rules) > max_local_rules:
            rules = spark.createDataFrame(rules, RULE_SCHEMA)
    if not isinstance(rules, list):
        rules = rules.select("action", F.lower("host").alias("host"), "path").dropna().distinct()
        head = rules.limit(max_local_rules + 1).collect()  # bounded: decides the way
        if len(head) > max_local_rules:
            return _ranged(urls, rules, ranges, salts)
        rules = [tuple(r) for r in head]
    held = list(rules)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Sweep(held)
        for b in batches:
            found = [state.judge(k, p) for k, p in zip(b["key"], b["path"])]
            yield b[["page_id", "host", "path"]].assign(rule=[r for r, _ in found], verdict=[v for _, v in found])

    return urls.sortWithinPartitions("key").mapInPandas(sweep, OUT)


def _ranged(urls: DataFrame, rules: DataFrame, ranges: int, salts: int) -> DataFrame:
    """Both sides dealt to key ranges; each range is swept as one sorted stream of rules and urls."""
    keyed = rules.withColumn("key", reversed_key(F.col("host")))
    starts = keyed.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("k"))
    bounds = sorted(r["k"] for r in starts.collect())  # at most `ranges` keys
    lits = F.array(*[F.lit(b) for b in bounds])
    place = lambda k: F.size(F.filter(lits, lambda b: b <= k))
    last = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    opened = (
        keyed.withColumn("range", F.explode(F.sequence(place(F.col("key")), place(last))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select("range", "salt", "key", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("page_id"), "host", "path", "action")
    )
    asked = urls.select(place(F.col("key")).alias("range"), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int").alias("salt"), "key", F.lit(1).alias("tag"), "page_id", "host", "path", F.lit(None).cast("string").alias("action"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = Sweep(), None
        for b in batches:
            out = []
            for r, s, key, tag, page, host, path, action in b.itertuples(index=False):
                if (r, s) != at:
                    state, at = Sweep(), (r, s)
                if tag == 0:
                    state.open(key, host, path, action)
                else:
                    out.append((int(page) if page == page and page is not None else None, host, path, *state.judge(key, path)))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

    return opened.unionByName(asked).repartition(ranges, "range", "salt").sortWithinPartitions("range", "salt", "key", "tag").mapInPandas(sweep, OUT)


SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(action, rhost, rpath)),
m AS (SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.action,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
