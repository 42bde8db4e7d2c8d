"""Stream state that forgets: entries leave by age (event time) and, beyond a cap, oldest first.

State is spread over keys, so no task holds all of it: histories by their own key, seen digests by shards of the digest.
Age goes by the watermark: an entry of time t leaves when the watermark passes t + ttl, by timers, even if its key gets no
further events. Both need the RocksDB state store, which keeps state on disk and its changes in the checkpoint folder, so a
restarted query goes on where it stopped. The batch twins give what a stream has after its last watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _checked(events: DataFrame) -> DataFrame:
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"state with timers needs spark.sql.streaming.stateStore.providerClass={ROCKS}")
    return events


class _Aging(StatefulProcessor):
    """Entries (id -> time in ms) of one key, the newest `cap` of those younger than `ttl` ms; a timer for each `step` of time."""

    def __init__(self, ttl: int, cap: int, keep: int):
        self.ttl, self.cap, self.keep = ttl, cap, keep
        self.step = max(1, ttl // 24)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "id string", "at long")
        self.size = handle.getValueState("size", "n long")

    def entries(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.held.iterator()}

    def count(self) -> int:
        return self.size.get()[0] if self.size.exists() else 0

    def add(self, fresh: dict[str, int]) -> None:
        timers = {-(-(at + self.ttl) // self.step) * self.step for at in fresh.values()}
        for i, at in fresh.items():
            self.held.updateValue((i,), (at,))
        for t in timers:
            self.handle.registerTimer(t)

    def drop(self, ids: list[str], n: int) -> None:
        for i in ids:
            self.held.removeKey((i,))
        if n:
            self.size.update((n,))
        else:
            self.size.clear()

    def shrink(self, n: int) -> None:
        """Past the cap: down to the newest `keep`."""
        if n <= self.cap:
            self.size.update((n,))
            return
        order = sorted(((at, i) for i, at in self.entries().items()), reverse=True)
        self.drop([i for _, i in order[self.keep :]], self.keep)

    def expired(self, watermark: int) -> None:
        held = self.entries()
        old = [i for i, at in held.items() if at + self.ttl <= watermark]
        self.drop(old, len(held) - len(old))

    def close(self) -> None:
        pass


class _Recent(_Aging):
    """After each batch, and when something expires: the key's ids, newest first."""

    def __init__(self, key: str, ttl: int, cap: int):
        super().__init__(ttl, cap, cap)
        self.key = key

    def snapshot(self, key) -> Iterator[pd.DataFrame]:
        ids = [i for _, i in sorted(((at, i) for i, at in self.entries().items()), reverse=True)]
        yield pd.DataFrame({self.key: [key[0]], "ids": [ids]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh: dict[str, int] = {}
        for b in rows:
            if len(b):
                fresh |= {i: int(at) for i, at in zip(b["state_id"], b["state_at"]) if at + self.ttl > watermark}
        new = sum(not self.held.containsKey((i,)) for i in fresh)
        self.add(fresh)
        self.shrink(self.count() + new)
        yield from self.snapshot(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expired(timerValues.getCurrentWatermarkInMs())
        yield from self.snapshot(key)


class _Seen(_Aging):
    """The rows whose digest isn't held: the first of each digest within ttl, by time, then as they come."""

    def __init__(self, ttl: int, cap: int, keep: int, columns: list[str]):
        super().__init__(ttl, cap, keep)
        self.columns = columns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count()
        for b in rows:
            if not len(b):
                continue
            b, first, fresh = b.sort_values("state_at", kind="stable"), [], {}
            for k, (i, at) in enumerate(zip(b["state_id"], b["state_at"])):
                before = fresh.get(i)
                if before is None and self.held.containsKey((i,)):
                    before = self.held.getValue((i,))[0]
                if before is None or at >= before + self.ttl:
                    n += before is None
                    first.append(k)
                    fresh[i] = int(at)
            self.add(fresh)
            yield b.iloc[first][self.columns]
        self.shrink(n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expired(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=self.columns)


def _timed(events: DataFrame, late: str, id: Column) -> DataFrame:
    return _checked(events).withWatermark("ts", late).withColumn("state_id", id).withColumn("state_at", F.unix_millis("ts"))


def recent_stream(events: DataFrame, key: str, seconds: int, cap: int, late: str = "10 minutes") -> DataFrame:
    """(key, ids) whenever a key's history changes: its newest `cap` events (event_id) of the last `seconds`, as text."""
    d = _timed(events, late, F.col("event_id").cast("string")).select(key, "ts", "state_id", "state_at")
    kind = d.schema[key].dataType.simpleString()
    return d.groupBy(key).transformWithStateInPandas(_Recent(key, seconds * 1000, cap), f"{key} {kind}, ids array<string>", "Update", "EventTime")


def recent(events: DataFrame, key: str, seconds: int, cap: int) -> DataFrame:
    """Batch twin: (key, event_id) of the newest `cap` events of each key among those of the last `seconds`."""
    last = F.broadcast(events.agg(F.max("ts").alias("_now")))
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc(F.col("event_id").cast("string")))
    live = events.join(last).where(F.col("ts") > F.col("_now") - F.make_interval(secs=F.lit(seconds)))
    return live.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).select(key, "event_id")


def first_seen_stream(events: DataFrame, columns: list[str], seconds: int, cap: int = 100_000, keep: int | None = None, shards: int = 64, late: str = "10 minutes") -> DataFrame:
    """The events that repeat none of the last `seconds` in those columns. Shards of digests hold cap / shards of them each;
    past that a shard forgets all but its newest keep / shards (half), so old repeats may pass then, as the cap implies."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    d = _timed(events, late, digest).withColumn("state_shard", F.pmod(F.xxhash64("state_id"), F.lit(shards)).cast("int"))
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields]
    each, stay = max(1, cap // shards), max(1, (keep or cap // 2) // shards)
    return d.groupBy("state_shard").transformWithStateInPandas(_Seen(seconds * 1000, each, stay, events.columns), ", ".join(out), "Append", "EventTime")


def first_seen(events: DataFrame, columns: list[str], seconds: int) -> DataFrame:
    """Batch twin without the cap: a repeat counts from the event that was let through last, so chains are walked in order of time."""
    d = events.withColumn("_id", F.sha2(F.to_json(F.struct(*columns)), 256)).withColumn("_at", F.unix_millis(F.col("ts").cast("timestamp")))
    # Runs of repeats with no gap of ttl between neighbours are independent; only within one is an order needed.
    w = Window.partitionBy("_id").orderBy("_at", "event_id")
    d = d.withColumn("_gap", F.coalesce(F.col("_at") - F.lag("_at").over(w) >= seconds * 1000, F.lit(True)))
    d = d.withColumn("_run", F.sum(F.col("_gap").cast("int")).over(w))
    simple = d.withColumn("_first", F.first("_at").over(Window.partitionBy("_id", "_run").orderBy("_at", "event_id")))
    # Within ttl of its run's first event each repeat goes; later ones are rare and folded.
    late = simple.where(F.col("_at") - F.col("_first") >= seconds * 1000).select("_id", "_run").distinct()
    plain = simple.join(late, ["_id", "_run"], "left_anti").where("_gap")
    folded = simple.join(late, ["_id", "_run"], "left_semi").groupBy("_id", "_run").agg(F.array_sort(F.collect_list(F.struct("_at", "event_id"))).alias("s"))
    empty = F.expr("cast(array() as array<struct<_at:bigint,event_id:bigint>>)")
    kept = folded.select(F.aggregate("s", empty, lambda out, x: F.when((F.size(out) == 0) | (x["_at"] >= F.element_at(out, -1)["_at"] + seconds * 1000), F.array_append(out, x)).otherwise(out)).alias("s"))
    ids = plain.select("event_id").unionByName(kept.select(F.explode("s").alias("x")).select("x.event_id"))
    return events.join(ids, "event_id", "left_semi")
