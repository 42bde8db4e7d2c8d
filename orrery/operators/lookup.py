"""Filters, lookups, roll-ups and small joins over records: tags, ranges, names, hierarchies, queues, exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.graph import cut


def tagged(df: DataFrame, tags: str, tag: str) -> DataFrame:
    """Rows whose array of tags holds the tag."""
    return df.where(F.array_contains(tags, tag))


def json_tagged(df: DataFrame, column: str, tags: list[str], kinds: dict[str, list]) -> DataFrame:
    """Rows whose columns are in the given lists and whose JSON array holds all the tags."""
    for name, values in kinds.items():
        df = df.where(F.col(name).isin(values))
    held = F.from_json(column, "array<string>")
    for t in tags:
        df = df.where(F.array_contains(held, t))
    return df


def range_page(df: DataFrame, column: str, low: Column | None, high: Column | None, order: list[Column], limit: int) -> DataFrame:
    """Rows with low <= column <= high, either bound open if None; the first `limit` in the order."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df.orderBy(*order).limit(limit)


def trailing(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last `days` days before now."""
    return df.where((F.col(ts) >= now - F.expr(f"interval {days} days")) & (F.col(ts) <= now))


def name_search(df: DataFrame, name: str, query: str, limit: int) -> DataFrame:
    """Names that hold the query in either case: equal ones first, then those that begin with it, then by name."""
    n, q = F.lower(name), query.lower()
    rank = F.when(n == q, 3).when(n.startswith(q), 2).when(n.contains(q), 1)
    return df.withColumn("rank", rank).where("rank is not null").orderBy(F.desc("rank"), name).limit(limit)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) both of whose ends are nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def near_pairs(mentions: DataFrame, by: str, at: str, kind: str, gap: int) -> DataFrame:
    """(by, first, second, distance) of mentions of different kinds at most `gap` apart, each pair once.

    A range join by cells of width `gap`: a partner is in the same cell or the next one. Mentions have an `id`.
    """
    d = mentions.select(by, "id", F.col(at).alias("at"), F.col(kind).alias("kind"), F.expr(f"{at} div {gap}").alias("cell"))
    left = d.select(by, F.col("id").alias("first"), F.col("at").alias("a"), F.col("kind").alias("ka"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    right = d.select(by, F.col("id").alias("second"), F.col("at").alias("b"), F.col("kind").alias("kb"), "cell")
    ahead = (F.col("b") > F.col("a")) | ((F.col("b") == F.col("a")) & (F.col("second") > F.col("first")))
    return left.join(right, [by, "cell"]).where(ahead & (F.col("b") - F.col("a") <= gap) & (F.col("ka") != F.col("kb"))).select(by, "first", "second", (F.col("b") - F.col("a")).alias("distance"))


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each left row with the first right row of its key, or with nulls."""
    w = Window.partitionBy(key).orderBy(*order)
    return left.join(right.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), key, "left")


def factor_exposure(positions: DataFrame, betas: DataFrame, by: str) -> DataFrame:
    """(by, factor, exposure): sum of weight times beta; `betas` has (symbol, betas: map factor -> beta)."""
    each = betas.select("symbol", F.explode("betas").alias("factor", "beta"))
    return positions.join(each, "symbol").groupBy(by, "factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"))


def portfolio_totals(positions: DataFrame, by: str, cash: float) -> DataFrame:
    """Total value with cash, total cost, and profit."""
    g = positions.groupBy(by).agg(F.sum("market_value").alias("mv"), F.sum("cost").alias("total_cost"))
    return g.select(by, (F.col("mv") + cash).alias("total_value"), "total_cost", (F.col("mv") - F.col("total_cost")).alias("total_pnl"))


def recurring(patterns: DataFrame, key: list[str], day: str, confidence: str, least: int) -> DataFrame:
    """Keys that occur `least` times or more, with first and last day and mean confidence."""
    g = patterns.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.avg(confidence).alias("confidence"))
    return g.where(F.col("n") >= least)


def queue_gauges(jobs: DataFrame, now: Column, window_seconds: int = 60) -> DataFrame:
    """One row over jobs (state, created, finished, seconds): counts by state, mean time, throughput, age of the oldest pending."""
    state = lambda s: F.count_if(F.col("state") == s)
    recent = (F.col("finished") > now - F.expr(f"interval {window_seconds} seconds")) & (F.col("finished") <= now)
    age = F.unix_micros(now.cast("timestamp")) - F.min(F.unix_micros(F.when(F.col("state") == "pending", F.col("created")).cast("timestamp")))
    return jobs.agg(state("pending").alias("pending"), state("done").alias("done"), state("failed").alias("failed"), F.avg("seconds").alias("mean_seconds"), (F.count_if(recent) / F.lit(window_seconds)).alias("per_second"), (age / 1e6).alias("oldest_age"))


def ordered_counts(df: DataFrame, by: str) -> DataFrame:
    """Groups by size, largest first, then by name."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def timeline(*parts: DataFrame) -> DataFrame:
    """(kind, day, id, ...) rows of several sources in one order, those without a day first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.asc_nulls_first("day"), "kind", "id")


def sweep(low: float, high: float, steps: int) -> Column:
    """Evenly spaced values from low to high, both included, one row each."""
    return F.explode(F.expr(f"transform(sequence(0, {steps - 1}), k -> {low!r}D + k * ({high - low!r}D / {max(steps - 1, 1)}))"))


def shock_shares(factors: DataFrame, by: str, loss: str) -> DataFrame:
    """Each factor's part of its group's loss, in proportion to the size of its shock."""
    total = F.sum(F.abs("shock")).over(Window.partitionBy(by))
    return factors.withColumn("contribution", F.when(total > 0, F.col(loss) * F.abs("shock") / total).otherwise(0.0))


def state_frequency(paths: DataFrame, states: str) -> DataFrame:
    """(state, n, share) of the states along all paths."""
    g = paths.select(F.explode(states).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("state", "n", (F.col("n") / F.col("total")).alias("share"))  # one row of totals


def hierarchy(links: DataFrame) -> DataFrame:
    """(child, ancestor, depth) up the links (child, parent), level after level, each ancestor at its least depth."""
    level = cut(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    out, depth = level, 1
    up = links.select(F.col("child").alias("ancestor"), "parent")
    while not level.isEmpty():
        depth += 1
        level = level.join(up, "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        level = cut(level.join(out.select("child", "ancestor"), ["child", "ancestor"], "left_anti").distinct())
        out = out.unionByName(level)
        if depth % 20 == 0:
            out = cut(out)
    return out


def alias_of(mention: Column, aliases: list[tuple[str, str]]) -> Column:
    """The name of the first alias, in their order, that the mention holds in either case; null without one."""
    low = F.lower(mention)
    return F.coalesce(*[F.when(low.contains(alias.lower()), F.lit(name)) for alias, name in aliases])


def latest_state(changes: DataFrame, key: str, ts: str, order: dict[str, int]) -> DataFrame:
    """Each key's last state, and when it first reached each state; a state never goes back in the order."""
    step = F.coalesce(*[F.when(F.col("state") == s, F.lit(k)) for s, k in order.items()])
    g = changes.withColumn("step", step).where("step is not null").groupBy(key)
    names = F.array(*[F.lit(s) for s, _ in sorted(order.items(), key=lambda x: x[1])])
    reached = [F.min(F.when(F.col("state") == s, F.col(ts))).alias(f"{s}_at") for s in order]
    return g.agg(F.max("step").alias("step"), *reached).withColumn("state", F.element_at(names, F.col("step") + 1)).drop("step")


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose next run has come, in the order of their runs."""
    return schedules.where(F.col("enabled") & (F.col("next_run") <= now)).orderBy("next_run", "schedule_id")


def factor_risk(exposures: DataFrame, covariance: DataFrame, specific: DataFrame, z: float) -> DataFrame:
    """(asset, mcr, ccr, var): sigma^2 = w'(B F B' + D) w; mcr = Sigma w / sigma, ccr = w mcr, var = z ccr.

    exposures: (asset, weight, factor, beta); covariance: (f, g, cov) in long form; specific: (asset, d).
    """
    weights = exposures.groupBy("asset").agg(F.first("weight").alias("weight"))
    total = exposures.groupBy(F.col("factor").alias("g")).agg(F.sum(F.col("weight") * F.col("beta")).alias("e"))
    pull = covariance.join(F.broadcast(total), "g").groupBy(F.col("f").alias("factor")).agg(F.sum(F.col("cov") * F.col("e")).alias("pull"))  # a row per factor
    sigma_w = exposures.join(F.broadcast(pull), "factor").groupBy("asset").agg(F.sum(F.col("beta") * F.col("pull")).alias("s"))
    rows = sigma_w.join(weights, "asset").join(specific, "asset").select("asset", "weight", (F.col("s") + F.col("d") * F.col("weight")).alias("s"))
    sigma = rows.agg(F.sqrt(F.sum(F.col("weight") * F.col("s"))).alias("sigma"))
    mcr = F.col("s") / F.col("sigma")
    return rows.join(F.broadcast(sigma)).select("asset", mcr.alias("mcr"), (F.col("weight") * mcr).alias("ccr"), (z * F.col("weight") * mcr).alias("var"))  # one row of sigma
