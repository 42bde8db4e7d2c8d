"""Sources and sinks on small files."""

import datetime as dt

from pyspark.sql import functions as F

from orrery.sources import tables


def test_columnar_json(spark):
    df = spark.createDataFrame([("x", [0, 86400], [1.0, 2.0], [2.0, 3.0], [0.5, 1.0], [1.5, 2.5], [10.0, 20.0])], "symbol string, t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>")
    rows = tables.bars_from_columns(df).orderBy("day").collect()
    assert [(r.day, r.close, r.volume) for r in rows] == [(dt.date(1970, 1, 1), 1.5, 10), (dt.date(1970, 1, 2), 2.5, 20)]


def test_csv_and_feed(spark, tmp_path):
    (tmp_path / "b.csv").write_text("symbol,day,open,high,low,close,volume\nx,2024-01-01,1,2,0.5,oops,7\n")
    r = tables.bars_from_csv(spark, str(tmp_path / "b.csv")).collect()[0]
    assert r.close is None and r.volume == 7
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://a</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    r = tables.feed(spark, str(tmp_path / "f.xml")).collect()[0]
    assert (r.title, r.url, r.published_at) == ("T", "http://a", dt.datetime(2024, 1, 1, 10))


def test_upsert_and_reports(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int")
    tables.upsert(a, f"{tmp_path}/t", ["id"], ["t"])
    now = tables.upsert(spark.createDataFrame([(1, "c", 2)], "id int, v string, t int"), f"{tmp_path}/t", ["id"], ["t"])
    assert sorted((r.id, r.v) for r in now.collect()) == [(1, "c"), (2, "b")]
    tables.reports(a, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    for k in range(2):
        spark.range(3 * k, 3 * k + 3).write.mode("append").parquet(src)
        tables.ingest_new_files(spark, "id long", src, out, check)
        assert spark.read.parquet(out).count() == 3 * (k + 1)


def test_watermark_is_the_greatest_value_seen(spark):
    df = spark.createDataFrame([(1,), (5,)], "t int")
    new, mark = tables.changed_since(df, "t", 1)
    assert mark == 5 and [r.t for r in new.collect()] == [5]
    assert tables.changed_since(df.where(F.lit(False)), "t", mark)[1] == 5
