"""Technical indicators and chart patterns over bars (symbol, day, high, low, close, volume).

All are window expressions per symbol in day order; patterns share one row format:
symbol, day, pattern, direction, score, confidence (label ladder).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _w() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


def last(n: int) -> Window:
    return _w().rowsBetween(1 - n, 0)


def confidence(score: Column) -> Column:
    """Score -> label; fixed bounds."""
    return F.when(score >= 0.85, "very_high").when(score >= 0.7, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("very_low")


def _full(n: int, value: Column) -> Column:
    """A rolling value only where its window is full."""
    return F.when(F.count(F.lit(1)).over(last(n)) == n, value)


def sma(n: int, column: str = "close") -> Column:
    return _full(n, F.avg(column).over(last(n)))


def rsi(n: int = 14) -> Column:
    """Simple-average RSI over `n` changes; 100 where nothing fell; rounded to 2."""
    d = F.col("close") - F.col("_before")
    gain, loss = F.avg(F.greatest(d, F.lit(0.0))).over(last(n)), F.avg(F.greatest(-d, F.lit(0.0))).over(last(n))
    value = F.when(loss == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    return F.when(F.row_number().over(_w()) > n, F.round(value, 2))


def ema_truncated(n: int) -> Column:
    """EMA seeded by the close `n` rows back and run over the rows since; a finite weighted sum."""
    a = 2.0 / (n + 1)
    out = F.lag("close", n - 1).over(_w()) * ((1 - a) ** (n - 1))
    for k in range(n - 1):
        out = out + F.lag("close", k).over(_w()) * (a * (1 - a) ** k)
    return F.when(F.row_number().over(_w()) >= n, F.round(out, 2))


def technical(bars: DataFrame) -> DataFrame:
    """SMA 20/50/200, Bollinger bands (2 population deviations), RSI 14, EMA 12/26 and MACD; rows before 200 bars go."""
    d = bars.withColumn("_before", F.lag("close").over(_w())).withColumn("_n", F.row_number().over(_w()))
    mid, dev = sma(20), F.stddev_pop("close").over(last(20))
    d = d.select("symbol", "day", "close", "_n", sma(20).alias("sma_20"), sma(50).alias("sma_50"), sma(200).alias("sma_200"), (mid + 2 * dev).alias("bb_upper"), (mid - 2 * dev).alias("bb_lower"), rsi().alias("rsi_14"), ema_truncated(12).alias("ema_12"), ema_truncated(26).alias("ema_26"))
    d = d.withColumn("macd", F.round(F.col("ema_12") - F.col("ema_26"), 2)).withColumn("macd_signal", F.round(0.9 * F.col("macd"), 2))
    return d.where("_n >= 200").drop("_n")


def ema_recursive(bars: DataFrame, n: int) -> DataFrame:
    """Full EMA from the first close on, as a fold of each symbol's ordered closes."""
    a = 2.0 / (n + 1)
    rows = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "close"))).alias("s"))
    fold = F.aggregate(
        "s",
        F.struct(F.lit(None).cast("double").alias("e"), F.expr("cast(array() as array<struct<day:date,ema:double>>)").alias("out")),
        lambda acc, x: F.struct(
            F.coalesce(a * x["close"] + (1 - a) * acc["e"], x["close"]).alias("e"),
            F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), F.coalesce(a * x["close"] + (1 - a) * acc["e"], x["close"]).alias("ema")))).alias("out"),
        ),
    )["out"]
    return rows.select("symbol", F.explode(fold).alias("x")).select("symbol", "x.day", "x.ema")


def features(bars: DataFrame) -> DataFrame:
    """Lags, rolling means and deviations, momentum and calendar columns; gaps of the close are filled forward."""
    d = bars.withColumn("close", F.last("close", ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    cols = [F.lag("close", k).over(_w()).alias(f"lag_{k}") for k in (1, 2, 3, 5, 10, 20, 60)]
    for n in (5, 10, 20, 60):
        cols += [_full(n, F.avg("close").over(last(n))).alias(f"mean_{n}"), _full(n, F.stddev_pop("close").over(last(n))).alias(f"std_{n}")]
    cols += [(F.col("close") - F.lag("close", k).over(_w())).alias(f"momentum_{k}") for k in (5, 20)]
    return d.select("symbol", "day", "close", *cols, F.weekday("day").alias("weekday"), F.month("day").alias("month"), F.quarter("day").alias("quarter"))


# Patterns.


def _pattern(d: DataFrame, name: str, direction: Column, score: Column) -> DataFrame:
    return d.select("symbol", "day", F.lit(name).alias("pattern"), direction.alias("direction"), score.alias("score"), confidence(score).alias("confidence"))


def trends(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """OLS slope and correlation of the last `span` closes per symbol: strong over 0.7, weak over 0.4."""
    d = bars.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day"))))
    out = None
    for n in spans:
        g = d.where(F.col("_k") <= n).groupBy("symbol").agg(F.regr_slope("close", -F.col("_k")).alias("slope"), F.corr("close", -F.col("_k").cast("double")).alias("corr"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
        g = g.select("symbol", F.lit(n).alias("span"), "slope", F.abs("corr").alias("strength"), F.when(F.abs("corr") > 0.7, "strong").when(F.abs("corr") > 0.4, "weak").otherwise("none").alias("label"), F.when(F.col("slope") > 0, "up").otherwise("down").alias("direction"))
        out = g if out is None else out.unionByName(g)
    return out


def crosses(bars: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """Golden and death crosses: the sign of the difference of two averages changes."""
    d = bars.withColumn("gap", sma(short) - sma(long)).withColumn("before", F.lag("gap").over(_w()))
    hit = d.where("(before <= 0 and gap > 0) or (before >= 0 and gap < 0)")
    return _pattern(hit, "ma_cross", F.when(F.col("gap") > 0, "golden_cross").otherwise("death_cross"), F.lit(0.8))


def breakouts(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close beyond the prior Donchian band while the prior close was not beyond its own, on 1.5 times the mean volume."""
    before = _w().rowsBetween(-n, -1)
    d = bars.withColumn("hi", F.max("high").over(before)).withColumn("lo", F.min("low").over(before)).withColumn("n", F.count(F.lit(1)).over(before)).withColumn("ratio", F.col("volume") / F.avg("volume").over(last(n)))
    for c in ("close", "hi", "lo", "n"):
        d = d.withColumn(f"p_{c}", F.lag(c).over(_w()))
    up, down = "close > hi and p_close <= p_hi", "close < lo and p_close >= p_lo"
    hit = d.where(f"p_n = {n} and ratio > 1.5 and (({up}) or ({down}))")
    return _pattern(hit, "breakout", F.when(F.col("close") > F.col("hi"), "up").otherwise("down"), F.least(F.col("ratio") / 3.0, F.lit(1.0)))


def rolling_z(bars: DataFrame, column: str, n: int, name: str, least: float, both: bool) -> DataFrame:
    """Rows whose value lies more than `least` sample deviations from the mean of the full window that ends there."""
    d = bars.withColumn("mu", F.avg(column).over(last(n))).withColumn("sd", F.stddev_samp(column).over(last(n))).withColumn("n", F.count(column).over(last(n)))
    d = d.withColumn("z", F.try_divide(F.col(column) - F.col("mu"), "sd"))
    hit = d.where((F.col("n") == n) & ((F.abs("z") if both else F.col("z")) > least))
    return _pattern(hit, name, F.when(F.col("z") > 0, "up").otherwise("down"), F.least(F.abs("z") / 5.0, F.lit(1.0)))


def volume_spikes(bars: DataFrame) -> DataFrame:
    return rolling_z(bars.withColumn("v", F.col("volume").cast("double")), "v", 30, "volume_spike", 3.0, False)


def anomalies(bars: DataFrame) -> DataFrame:
    """Daily returns beyond 3 deviations over 60 rows."""
    d = bars.withColumn("r", F.col("close") / F.lag("close").over(_w()) - 1)
    return rolling_z(d, "r", 60, "anomaly", 3.0, True)


def regime_changes(bars: DataFrame) -> DataFrame:
    """Onsets of unusual volatility: 20-row yearly deviation of returns beyond 2 deviations of its 60-row mean."""
    d = bars.withColumn("r", F.col("close") / F.lag("close").over(_w()) - 1)
    d = d.withColumn("vol", F.when(F.count("r").over(last(20)) == 20, F.stddev_samp("r").over(last(20)) * F.sqrt(F.lit(252.0))))
    d = d.withColumn("z", F.when(F.count("vol").over(last(60)) == 60, F.try_divide(F.col("vol") - F.avg("vol").over(last(60)), F.stddev_samp("vol").over(last(60)))))
    d = d.withColumn("flag", F.coalesce(F.abs("z") > 2, F.lit(False))).withColumn("was", F.lag("flag", 1, False).over(_w()))
    return _pattern(d.where("flag and not was"), "regime_change", F.when(F.col("z") > 0, "up").otherwise("down"), F.least(F.abs("z") / 4.0, F.lit(1.0)))


def extrema(bars: DataFrame, order: int) -> DataFrame:
    """Strict local extrema: rows above (below) all of the `order` rows on either side."""
    before, after = _w().rowsBetween(-order, -1), _w().rowsBetween(1, order)
    full = (F.count(F.lit(1)).over(before) == order) & (F.count(F.lit(1)).over(after) == order)
    d = bars.withColumn("top", full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)))
    d = d.withColumn("bottom", full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)))
    tops = d.where("top").select("symbol", "day", F.lit("top").alias("kind"), F.col("high").alias("price"))
    return tops.unionByName(d.where("bottom").select("symbol", "day", F.lit("bottom").alias("kind"), F.col("low").alias("price")))


def support_resistance(bars: DataFrame, order: int = 20, eps: float = 0.02, touches: int = 3) -> DataFrame:
    """Levels touched `touches` times or more: extrema whose neighbours in price lie within eps form a chain."""
    w = Window.partitionBy("symbol", "kind").orderBy("price", "day")
    d = extrema(bars, order).withColumn("new", F.coalesce((F.col("price") - F.lag("price").over(w) > eps).cast("int"), F.lit(1)))
    d = d.withColumn("level", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy("symbol", "kind", "level").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("touch_count"), F.max("day").alias("day")).where(F.col("touch_count") >= touches)
    score = F.least(F.col("touch_count") / 10.0, F.lit(1.0))
    return g.select("symbol", "day", F.when(F.col("kind") == "top", "resistance").otherwise("support").alias("type"), "price", "touch_count", score.alias("score"))


def reversals(bars: DataFrame, order: int = 10, near: float = 0.03, depth: float = 0.05) -> DataFrame:
    """Double tops and bottoms: neighbouring extrema of one kind within `near`, and between them a retreat of over `depth`."""
    e = extrema(bars, order)
    w = Window.partitionBy("symbol", "kind").orderBy("day")
    pairs = e.withColumn("day2", F.lead("day").over(w)).withColumn("price2", F.lead("price").over(w)).where(F.abs(F.col("price2") - F.col("price")) / F.col("price") <= near)
    inner = bars.select(F.col("symbol").alias("s"), F.col("day").alias("d"), "low", "high")
    d = pairs.join(inner, (F.col("symbol") == F.col("s")) & (F.col("d") > F.col("day")) & (F.col("d") < F.col("day2")))
    g = d.groupBy("symbol", "kind", "day", "day2", "price", "price2").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    level = (F.col("price") + F.col("price2")) / 2
    neck = F.when(F.col("kind") == "top", F.col("lo")).otherwise(F.col("hi"))
    g = g.withColumn("neck", neck).withColumn("depth", F.abs(level - F.col("neck")) / level).where(F.col("depth") > depth)
    return g.select("symbol", F.col("day2").alias("day"), F.when(F.col("kind") == "top", "double_top").otherwise("double_bottom").alias("pattern"), level.alias("peak_price"), "neck", (2 * F.col("neck") - level).alias("target_price"), "depth")


def cycles(bars: DataFrame, longest: int = 100, height: float = 0.3, apart: int = 5, least: float = 0.4) -> DataFrame:
    """Autocorrelation of closes by lag, as window correlations; local peaks, the highest first, at least `apart` lags apart."""
    d = bars.select("symbol", "day", "close")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("close", k).over(_w()).alias("before")) for k in range(1, longest + 1)])
    stacked = d.withColumn("n", n).withColumn("lags", lags).select("symbol", "n", "close", F.explode("lags").alias("x"))
    g = stacked.where("x.before is not null and x.lag <= n / 4").groupBy("symbol", F.col("x.lag").alias("lag")).agg(F.corr("close", "x.before").alias("corr"))
    w = Window.partitionBy("symbol").orderBy("lag")
    peaks = g.withColumn("a", F.lag("corr").over(w)).withColumn("b", F.lead("corr").over(w)).where(f"corr > a and corr > b and corr >= {height}")
    near = Window.partitionBy("symbol").orderBy("lag").rangeBetween(1 - apart, apart - 1)
    return peaks.withColumn("best", F.max("corr").over(near)).where("corr >= best").where(f"corr > {least} and lag > 5").select("symbol", "lag", "corr")


def seasonality(bars: DataFrame) -> DataFrame:
    """Power of the periods 12, 6 and 3 in detrended month-end closes (24 months or more): symbol, period, strength."""
    ends = bars.groupBy("symbol", F.last_day("day").alias("month")).agg(F.max_by("close", "day").alias("close"))

    def spectrum(g: pd.DataFrame) -> pd.DataFrame:
        y = g.sort_values("month")["close"].to_numpy()
        if len(y) < 24:
            return pd.DataFrame({"symbol": [], "period": [], "strength": []})
        t = np.arange(len(y))
        y = y - np.polyval(np.polyfit(t, y, 1), t)
        power, freq = np.abs(np.fft.rfft(y)) ** 2, np.fft.rfftfreq(len(y))
        share = power[1:] / max(power[1:].sum(), 1e-300)
        rows = [(g["symbol"].iloc[0], p, float(share[int(np.argmin(np.abs(freq[1:] - 1 / p)))])) for p in (12, 6, 3)]
        return pd.DataFrame([r for r in rows if r[2] > 0.1], columns=["symbol", "period", "strength"])

    return ends.groupBy("symbol").applyInPandas(spectrum, "symbol string, period long, strength double")


PATTERNS = {"ma_cross": crosses, "breakout": breakouts, "volume_spike": volume_spikes, "anomaly": anomalies, "regime_change": regime_changes}


def detect(bars: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All asked-for patterns in one format; an unknown kind gives nothing."""
    out = None
    for k in kinds or list(PATTERNS):
        if k in PATTERNS:
            found = PATTERNS[k](bars)
            out = found if out is None else out.unionByName(found)
    return out


def similar(bars: DataFrame, symbol: str, n: int = 60) -> DataFrame:
    """Symbols by the distance of their z-normalised last `n` closes from one symbol's."""
    d = bars.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))).where(F.col("k") <= n)
    w = Window.partitionBy("symbol")
    d = d.select("symbol", "k", F.try_divide(F.col("close") - F.avg("close").over(w), F.stddev_pop("close").over(w)).alias("z"))
    mine = d.where(F.col("symbol") == symbol).select("k", F.col("z").alias("mine"))
    g = d.where(F.col("symbol") != symbol).join(mine, "k").groupBy("symbol").agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("mine"), 2))).alias("distance"))
    return g.withColumn("similarity", 1.0 / (1.0 + F.col("distance")))
