"""Fixed views of the domain over the base tables, for Spark and as SQL.

Money is added up as decimals before it becomes double, so both engines start from identical numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def total(column: str) -> Column:
    return F.sum(money(column)).cast("double")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, day, high, low, close, volume): brands as symbols, volume-weighted close."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.max(price).alias("high"), F.min(price).alias("low"), (total("l_extendedprice") / total("l_quantity")).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
    )


BARS = """bars AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, day, value): monthly order value of each market segment."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_mktsegment").alias("portfolio"), F.date_trunc("month", "o_orderdate").cast("date").alias("day")).agg(total("o_totalprice").alias("value"))


SNAPSHOTS = """snapshots AS (SELECT c_mktsegment AS portfolio, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
RETURNS = SNAPSHOTS + """, returns AS (SELECT portfolio, day, value, (value - prev) / prev AS r FROM
  (SELECT *, lag(value) OVER (PARTITION BY portfolio ORDER BY day) AS prev FROM snapshots) WHERE prev > 0)"""


def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, value): monthly order value over all segments."""
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("day")).agg(total("o_totalprice").alias("value"))


MARKET = """market AS (SELECT day, (value - prev) / prev AS b FROM (SELECT *, lag(value) OVER (ORDER BY day) AS prev FROM
  (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1)) WHERE prev > 0)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, symbol, sector, market_value, cost): segment holdings by brand, sector by part type."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("portfolio"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("sector")).agg(
        total("l_extendedprice").alias("market_value"), total("l_quantity").alias("quantity")
    )


POSITIONS = """positions AS (SELECT c_mktsegment AS portfolio, p_brand AS symbol, p_type AS sector, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS market_value,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded and dates as text, for comparison across engines."""
    shown = {"double": lambda c: F.round(c, digits), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[shown.get(t, F.col)(c).alias(c) for c, t in df.dtypes])
