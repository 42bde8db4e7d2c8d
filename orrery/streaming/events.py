"""Event stream operators: the same functions serve batch and Structured Streaming where the semantics allow it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def matching(events: DataFrame, types: list[str] | None = None, least_priority: int | None = None) -> DataFrame:
    """Filter by type and priority, all given tests together."""
    d = events.where(F.col("event_type").isin(types)) if types else events
    return d.where(F.col("priority") >= least_priority) if least_priority is not None else d


def tumbling(events: DataFrame, size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by type in tumbling or sliding event-time windows; a watermark bounds state on streams."""
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def latest_per_key(events: DataFrame, key: str = "event_type") -> DataFrame:
    """The last event of each key by event time; update mode on streams."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_id", "value", "ts"), "ts").alias("e")).select(key, "e.event_id", "e.value", "e.ts")


def last_n(events: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """Batch form of the bounded history: the last n events of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def last_n_stream(events: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """Stream form: (key, ids of the last n events) after each batch, kept in state of at most n entries a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held += list(zip(b["ts"].astype("int64"), b["event_id"]))
        held = sorted(held)[-n:]
        state.update(([int(t) for t, _ in held], [int(i) for _, i in held]))
        yield pd.DataFrame({key: [k[0]], "ids": [[int(i) for _, i in held]]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, ids array<long>", "ts array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def dedup(events: DataFrame, columns: list[str], late: str) -> DataFrame:
    """Drops repeats of a content hash that arrive within the watermark."""
    d = events.withColumn("digest", F.sha2(F.concat_ws("|", *columns), 256)).withWatermark("ts", late)
    return d.dropDuplicatesWithinWatermark(["digest"])


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, event): a stream-static join on topic; a subscriber gets an event once."""
    topics = F.array(F.col("event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.lit("all"))
    d = events.withColumn("topic", F.explode(topics)).join(subscriptions, "topic")
    return d.dropDuplicates(["subscriber", "event_id"]).drop("topic")


def split_dead_letters(events: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Good rows and dead letters, by one test; nulls are bad."""
    ok = F.coalesce(valid, F.lit(False))
    return events.where(ok), events.where(~ok)


def backoff(attempts: DataFrame, base: float = 5.0, most: float = 300.0, limit: int = 3) -> DataFrame:
    """Next delay min(base 2^attempt, most) and state of failed events: retry below the limit, else dead."""
    delay = F.least(base * F.pow(F.lit(2.0), F.col("attempt")), F.lit(most))
    return attempts.withColumn("delay", delay).withColumn("state", F.when(F.col("attempt") < limit, "retry").otherwise("dead"))


def ready(queue: DataFrame, now, count: int) -> DataFrame:
    """Head of a priority queue: events before the first one still scheduled, at most `count`."""
    w = Window.orderBy("priority", F.col("scheduled_at").asc_nulls_last(), "event_id")
    ranked = queue.orderBy("priority", F.col("scheduled_at").asc_nulls_last(), "event_id").limit(count).withColumn("position", F.row_number().over(w))
    blocked = ranked.where(F.col("scheduled_at") > now).agg(F.coalesce(F.min("position"), F.lit(count + 1)).alias("stop"))
    return ranked.join(F.broadcast(blocked)).where("position < stop").drop("stop")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time: one union and one window, no range join."""
    both = left.select(key, ts, "id", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(key, ts, F.lit(None).cast("long").alias("id"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side")))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("id", key, ts, "as_of")
