"""Staged tables take the shuffle files on their way with them, so that those of many steps don't add up on disk."""

import time

import pytest
from pyspark.sql import functions as F

from orrery.llm.common import CLEANUP, Staging, shuffles_end


def shuffled(spark):
    """Bytes of each shuffle's data files that are on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = {}
    for f in (files.apply(i) for i in range(files.size())):
        if f.getName().startswith("shuffle_") and f.getName().endswith(".data"):
            found[f.getName().split("_")[1]] = found.get(f.getName().split("_")[1], 0) + f.length()
    return found


def left(spark, before):
    """Bytes of the shuffles that came since; files may take a moment to go."""
    for _ in range(50):
        if (n := sum(v for k, v in shuffled(spark).items() if k not in before)) == 0:
            break
        time.sleep(0.1)
    return n


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(20_000).groupBy(F.col("id") % 5000).agg(F.count(F.lit(1)).alias("n"))
    kept = Staging(spark, "test").keep(rows)  # both are held, so no collection of garbage removes anything
    assert left(spark, before) == 0
    assert kept.count() == rows.count() == 5000
    assert {r.n for r in kept.collect()} == {4}


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_the_setting_of_the_session_comes_back(spark, own):
    was = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)
        found = spark.conf.get(CLEANUP, None)
        with pytest.raises(ZeroDivisionError), shuffles_end(spark):
            assert spark.conf.get(CLEANUP) == "true"
            1 / 0
        assert spark.conf.get(CLEANUP, None) == found
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
