"""Daily metrics kept up to date against those of all trades, and messages that are sent twice."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.sources import readers, writers
from tidemark.streaming import ingest
from tidemark.streaming import operators as st
from tidemark.streaming.daily import refresh_daily

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, price double, quantity double, timestamp timestamp_ntz, trade_id bigint, is_buyer_maker boolean"


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(2)
    at = sorted(rng.uniform(0, 24 * 9) for _ in range(700))
    rows = [(rng.choice("AB"), round(rng.uniform(-1, 50), 2), float(rng.randrange(3)), START + dt.timedelta(hours=h), i, rng.choice([True, False, None])) for i, h in enumerate(at) if not 80 < h < 130]
    return spark.createDataFrame(rows, SCHEMA).cache()


def rows_of(df):
    names = ["symbol", "date", "open", "high", "low", "close", "volume", "trades", "vwap", "taker_buy_share", "volatility", "return"]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).collect())


def test_days_made_anew_by_batches_equal_all_at_once(spark, trades, tmp_path):
    folder, hours = str(tmp_path), bars.hourly_sums(trades).drop("interval").cache()
    day = F.dayofmonth("timestamp")
    # days 1 and 3; then 2, which lies between; then the rest; then half of day 1 again
    for part in (hours.filter(day.isin(1, 3)), hours.filter(day == 2), hours.filter(day > 3), hours.filter((day == 1) & (F.hour("timestamp") < 12)), hours.limit(0)):
        refresh_daily(part, folder)
    assert rows_of(spark.read.parquet(f"{folder}/daily_metrics")) == rows_of(bars.daily_metrics(trades))


def test_only_the_changed_days_are_written(spark, trades, tmp_path):
    hours = bars.hourly_sums(trades).drop("interval").cache()
    refresh_daily(hours, str(tmp_path))
    times = lambda: {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "daily_metrics").rglob("*.parquet")}
    before = times()
    refresh_daily(hours.filter(F.dayofmonth("timestamp") == 4), str(tmp_path))
    assert {d for d, t in times().items() if t != before[d]} == {"date=2024-01-04", "date=2024-01-06"}  # no trades on the 5th


def test_pipeline_keeps_daily_metrics_over_two_runs(spark, trades, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (trades.filter("timestamp < '2024-01-03 07:20:00'"), trades.filter("timestamp >= '2024-01-03 07:20:00'")):
        part.coalesce(1).write.mode("append").parquet(source)
        st.run_pipeline(spark.readStream.schema(SCHEMA).parquet(source), folder)
    newest = trades.agg(F.max("timestamp")).first()[0] - dt.timedelta(minutes=10)
    closed = trades.filter(F.date_trunc("hour", "timestamp") + F.expr("interval 1 hour") <= F.lit(newest))
    assert rows_of(spark.read.parquet(f"{folder}/daily_metrics")) == rows_of(bars.daily_metrics(closed))
    assert ingest.ingested(spark, folder, st.TRADES).count() == trades.count()
    sent = spark.read.schema("key string, value string, batch bigint, number bigint").json(f"{folder}/topics/processed_data")
    assert sent.filter("batch is null or number is null").isEmpty() and readers.first_sent(sent.union(sent)).count() == sent.count() > 0


def test_a_batch_sent_again_changes_nothing_for_a_consumer(spark):
    rows = [("A", START + dt.timedelta(hours=i), float(i)) for i in range(5)] + [("B", START, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, v double")
    first = writers.in_sequence(writers.to_messages(df), 3)
    again = writers.in_sequence(writers.to_messages(df.orderBy(F.desc("v")).repartition(3)), 3)
    other = writers.in_sequence(writers.to_messages(df), 4)
    once = sorted(map(tuple, first.collect()))
    assert [n for *_, n in once] == [1, 2, 3, 4, 5, 1] and [v for k, v, *_ in once if k == "A"] == sorted(v for k, v, *_ in once if k == "A")
    assert sorted(map(tuple, readers.first_sent(first.union(again)).collect())) == once
    assert readers.first_sent(first.union(again).union(other)).count() == 12
