"""What the text operators share: word splitting, staging tables and reading inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def has_word(text: Column) -> Column:
    """Whether there is anything but white space."""
    return F.ltrim(text, F.lit(WHITE)) != ""


def each_of(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """A row for each of the n elements of an array column, which goes.

    By number: exploding a computed array would have the optimizer compute it once more to filter empty ones.
    """
    rest = [c for c in df.columns if c != column]
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_at")).select(*rest, F.get(column, F.col("_at")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a local session without it gets one of its own (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@lru_cache(maxsize=None)
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='orrery-')}"


#: Shuffle files go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Actions in here take their shuffle files with them.

    Else these stay until the driver happens to collect its garbage, and the shuffles of many steps add up on disk. Only for
    data frames that run once; what callers get keeps to the session's own setting.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Staging:
    """Tables written to the shared folder; they cut lineage and outlive a lost executor. Shuffles on their way go once they are written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, partition_files: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        with shuffles_end(self.spark):
            (df.coalesce(partition_files) if partition_files else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: str = "32m", rows: str = "2000") -> None:
    """Arrow batches by bytes, so that long texts can't add up; settings that the session has already stay."""
    for key, value, default in (("spark.sql.execution.arrow.maxBytesPerBatch", size, None), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows, "10000")):
        try:
            now = spark.conf.get(key)
        except Exception as e:  # the setting is unknown to this version
            if "NO_SUCH" in str(e) or "SQL_CONF_NOT_FOUND" in str(e):
                continue
            raise
        if default is None or now == default:
            if default is not None or int(str(now).lower().rstrip("b") or 0) > 1 << 30 if str(now).lower().rstrip("b").isdigit() else True:
                spark.conf.set(key, value)
