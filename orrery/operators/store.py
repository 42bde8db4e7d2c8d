"""Storage operators over plain tables: finders, latest-row upserts, versions, retention, eviction, paging, usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Rows that meet all given equalities (None is no condition; a list means membership), ordered, paged."""
    tests = [F.col(c).isin(x) if isinstance(x, (list, tuple)) else F.col(c) == x for c, x in equal.items() if x is not None]
    d = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    d = d.orderBy(*order)
    return d.offset(offset).limit(limit) if limit is not None else d


def overlapping(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Rows whose [start, end] meets [low, high]."""
    return df.where((F.col(end) >= low) & (F.col(start) <= high))


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics of an append-only table: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def merge(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(target.unionByName(changes), keys, order)


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def changes(incoming: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, updated (another digest) or unchanged."""
    old = existing.select(key, F.col(digest).alias("_old"))
    return incoming.join(old, key, "left").select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col(digest), "updated").otherwise("unchanged").alias("status"))


def versions(df: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Version numbers per key: one more whenever the content's digest changes in time."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.coalesce((F.lag(digest).over(w) != F.col(digest)).cast("int"), F.lit(1))
    return df.withColumn("_s", step).withColumn("version", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def evict(df: DataFrame, by: str, size: str, accessed: str, capacity: int, tie: str) -> DataFrame:
    """What stays of each cache: the most recently used rows that fit its capacity."""
    w = Window.partitionBy(by).orderBy(F.desc(accessed), tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= capacity)


def retained(df: DataFrame, now: Column, max_age_days: int, least_rank: int, per_scope: int) -> DataFrame:
    """Memories that stay: not expired, not (unimportant, old and unused), the best `per_scope` of each scope."""
    rank = F.expr("case importance when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end")
    d = df.withColumn("rank", rank).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    d = d.where(~((F.col("rank") <= least_rank) & (F.datediff(now, "created_at") > max_age_days) & (F.col("access_count") < 2)))
    w = Window.partitionBy("scope").orderBy(F.desc("rank"), F.desc("created_at"), "id")
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_scope).drop("_k")


def keyword_search(df: DataFrame, text: str, query: str, id: str, limit: int) -> DataFrame:
    """Rows by the number of distinct query words they hold, most first; rows with none go."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    score = F.size(F.array_intersect(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+")), words))
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), id).limit(limit)


def first_available(sources: list[DataFrame], key: str) -> DataFrame:
    """Per key the row of the first source that has it."""
    d = reduce(DataFrame.unionByName, [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)])
    w = Window.partitionBy(key).orderBy("_p")
    return d.withColumn("_k", F.row_number().over(w)).where("_k = 1").withColumnRenamed("_p", "source_rank").drop("_k")


def usage(calls: DataFrame) -> DataFrame:
    """Per tool, per category and in all, by grouping sets: calls, successes, mean duration, cost."""
    g = calls.groupingSets([["tool"], ["category"], []], "tool", "category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("success"), F.avg("duration").alias("mean_duration"), F.sum("cost").alias("cost"))
    return g


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, extremes, mean, sample deviation, and nearest-rank percentiles at index floor(n p / 100)."""
    w = Window.partitionBy(by)
    ranked = df.select(by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.col("n") * p / 100), F.col(value)))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.median(value).alias("median"), at(95).alias("p95"), at(99).alias("p99"))


def consolidate(rows: DataFrame, by: str) -> DataFrame:
    """Groups merged into one row: union of tags, mean confidence, all verified."""
    return rows.groupBy(by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.avg("confidence").alias("confidence"), F.bool_and("verified").alias("verified"), F.count(F.lit(1)).alias("n"))


def link_both(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """New links in both directions that aren't there yet."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.join(existing.select("a", "b"), ["a", "b"], "left_anti")


def trend(df: DataFrame, by: str, t: str, y: str) -> DataFrame:
    """Slope, r squared, mean and median growth, and compound growth from first to last."""
    w = Window.partitionBy(by).orderBy(t)
    d = df.withColumn("_p", F.lag(y).over(w)).withColumn("_g", F.try_divide(F.col(y) - F.col("_p"), F.abs("_p")))
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, t).alias("slope"), F.regr_r2(y, t).alias("r2"), F.avg("_g").alias("mean_growth"), F.median("_g").alias("median_growth"), F.min_by(y, t).alias("first"), F.max_by(y, t).alias("last"), F.avg(y).alias("mean"))
    return g.withColumn("cagr", F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("n") > 1), F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1)) - 1)).withColumn("to_mean", F.try_divide("last", "mean"))
