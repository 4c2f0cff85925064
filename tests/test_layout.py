"""Tables in folders by interval and date: what a lookup reads of them, and merging into them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookups
from tidemark.sources import writers

START = dt.datetime(2024, 1, 1)


def bars(spark, n, symbols=5, interval="1m"):
    """n minute bars, dealt to symbols in turn."""
    time = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") / symbols).cast("int"))
    price = F.col("id").cast("double")
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id") % symbols).alias("symbol"), F.lit(interval).alias("interval"), time.alias("timestamp"), price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), price.alias("volume"))


def scan(spark, *lookup):
    """(rows, metrics, description) of a lookup and its only file scan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan that ran is within another
    try:
        df = lookups.stored_bars(spark, *lookup)
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert leaves.size() == 1
    leaf = leaves.apply(0)
    return rows, {k: leaf.metrics().apply(k).value() for k in ("numFiles", "numOutputRows", "numPartitions")}, leaf.verboseStringWithOperatorId()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    both = bars(spark, 40_000).union(bars(spark, 4_000, interval="1h"))
    writers.write_laid_out(both.withColumn("date", F.to_date("timestamp")), path, ["interval", "date"], ["symbol", "timestamp"])
    return path


def test_lookup_reads_only_the_folders_of_its_range(spark, stored):
    rows, metrics, text = scan(spark, stored, "1m", "s3", "2024-01-02 12:00:00", "2024-01-03 12:00:00")
    want = bars(spark, 40_000).filter("symbol = 's3' and timestamp >= '2024-01-02 12:00:00' and timestamp < '2024-01-03 12:00:00'").orderBy(F.desc("timestamp")).collect()
    assert [r.timestamp for r in rows] == [r.timestamp for r in want] and len(rows) == 24 * 60
    assert metrics["numPartitions"] == 2 and metrics["numFiles"] <= 4  # of 6 days, and of those with hourly bars
    parts, pushed = text.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "interval" in parts and "date" in parts
    assert "EqualTo(symbol,s3)" in pushed and "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed


def test_sorted_files_let_pages_be_left_out(spark, tmp_path):
    path = str(tmp_path / "t")
    many = bars(spark, 300_000, symbols=300)
    writers.write_laid_out(many.withColumn("date", F.to_date("timestamp")), path, ["interval", "date"], ["symbol", "timestamp"])
    rows, metrics, _ = scan(spark, path, "1m", "s7", "2024-01-01", "2024-01-02")
    assert len(rows) == 1000 and metrics["numOutputRows"] <= 60_000


def test_merging_touches_only_its_folders(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["symbol", "interval", "timestamp"]
    both = bars(spark, 20_000).union(bars(spark, 2_000, interval="1h"))
    writers.upsert(both, path, keys, parts=["interval", "date"])
    mtimes = lambda: {str(f.relative_to(tmp_path / "t")): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = mtimes()
    change = bars(spark, 20_000).filter("timestamp >= '2024-01-02 01:00:00' and timestamp < '2024-01-02 02:00:00'").withColumn("close", F.lit(-1.0))
    for _ in range(2):
        writers.upsert(change, path, keys, parts=["interval", "date"])
    kept = [f for f, t in mtimes().items() if before.get(f) == t]
    assert {f.rpartition("/")[0] for f in before} - {f.rpartition("/")[0] for f in kept} == {"interval=1m/date=2024-01-02"}
    got = spark.read.parquet(path)
    assert got.count() == 22_000 and got.filter("close = -1").count() == 300
    assert got.select(*keys).distinct().count() == 22_000


def test_expired_days_of_all_intervals_go(spark, tmp_path):
    path = str(tmp_path / "t")
    both = bars(spark, 20_000).union(bars(spark, 20_000, interval="1h"))
    writers.upsert(both, path, ["symbol", "interval", "timestamp"], parts=["interval", "date"])
    assert writers.drop_expired(spark, path, "1 day", dt.datetime(2024, 1, 3)) == [dt.date(2024, 1, 1)]
    assert {str(r.date) for r in spark.read.parquet(path).select("date").distinct().collect()} == {"2024-01-02", "2024-01-03"}
    assert {r.interval for r in spark.read.parquet(path).select("interval").distinct().collect()} == {"1m", "1h"}


def test_lookup_of_a_symbol_that_is_not_there(spark, stored):
    assert lookups.stored_bars(spark, stored, "1m", "none", "2024-01-02", "2024-01-03").collect() == []
    assert lookups.stored_bars(spark, stored, "4h", "s1", "2024-01-02", "2024-01-03").collect() == []


def test_a_lookup_reads_its_pages_once(spark, tmp_path):
    """A page has 20,000 rows, and a symbol lies on two at most: not read again to find the ranges of the sort."""
    path = str(tmp_path / "t")
    many = bars(spark, 300_000, symbols=300)
    writers.write_laid_out(many.withColumn("date", F.to_date("timestamp")), path, ["interval", "date"], ["symbol", "timestamp"])
    for symbol in ("s7", "s120", "s250"):
        rows, metrics, _ = scan(spark, path, "1m", symbol, "2024-01-01", "2024-01-02")
        times = [r.timestamp for r in rows]
        assert len(times) == 1000 and times == sorted(times, reverse=True) and metrics["numOutputRows"] <= 40_000
