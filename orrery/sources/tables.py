"""Sources and sinks: landing folders, columnar JSON, feeds, upserts, reports and streams with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.store import latest

BAR = "symbol string, day date, open double, high double, low double, close double, volume long"


def bars_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV with a fixed schema; broken numbers become null."""
    return spark.read.schema(BAR).option("header", True).option("mode", "PERMISSIVE").csv(path)


def bars_from_columns(df: DataFrame) -> DataFrame:
    """Rows from parallel arrays (symbol, t, o, h, l, c, v), as columnar REST answers have them."""
    z = F.explode(F.arrays_zip("t", "o", "h", "l", "c", "v")).alias("z")
    return df.select("symbol", z).select("symbol", F.timestamp_seconds("z.t").cast("date").alias("day"), F.col("z.o").alias("open"), F.col("z.h").alias("high"), F.col("z.l").alias("low"), F.col("z.c").alias("close"), F.col("z.v").cast("long").alias("volume"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Articles from RSS files by the built-in XML source."""
    schema = "title string, link string, description string, pubDate string"
    d = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return d.select("title", F.col("link").alias("url"), F.col("description").alias("summary"), F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def upsert(changes: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Appends changes and gives the current state: the latest row of each key."""
    changes.write.mode("append").parquet(path)
    return latest(changes.sparkSession.read.parquet(path), keys, order)


def reports(df: DataFrame, path: str) -> None:
    """One JSON row per report."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def ingest_new_files(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Everything that came since the last call, once: a file stream with a checkpoint, run until it is up to date."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def changed_since(df: DataFrame, column: str, watermark) -> tuple[DataFrame, object]:
    """Rows after a watermark, and the next watermark: the greatest value seen, not the time of the run."""
    new = df.where(F.col(column) > watermark) if watermark is not None else df
    return new, new.agg(F.max(column)).first()[0] or watermark
