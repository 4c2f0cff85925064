"""The stream pipeline stopped and run again: the tables equal those of one run, and a repeat changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.readers import events_as_trades
from tidemark.streaming import operators as streaming

EVENTS = "/root/testdata/sf0.001/events.parquet"
TABLES = ["ohlcv", "indicators", "anomalies"]


def run(spark, source, folder, schema):
    streaming.run_pipeline(streaming.with_event_time(events_as_trades(spark.readStream.schema(schema).parquet(source))), folder)
    return {t: sorted(map(str, spark.read.parquet(f"{folder}/{t}").collect())) if os.path.isdir(f"{folder}/{t}") else [] for t in TABLES}


@pytest.mark.skipif(not os.path.isfile(EVENTS), reason="no test data")
def test_stopped_and_run_again(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    time = next(f.name for f in events.schema if f.dataType.typeName().startswith("timestamp"))
    middle = events.agg(F.expr(f"percentile_approx({time}, 0.5)")).first()[0]
    first, second = events.filter(F.col(time) <= F.lit(middle)), events.filter(F.col(time) > F.lit(middle))
    source, whole = str(tmp_path / "in"), str(tmp_path / "whole")
    events.coalesce(1).write.parquet(whole)
    first.coalesce(1).write.parquet(source)
    half = run(spark, source, str(tmp_path / "out"), events.schema)
    second.coalesce(1).write.mode("append").parquet(source)
    resumed = run(spark, source, str(tmp_path / "out"), events.schema)
    once = run(spark, whole, str(tmp_path / "once"), events.schema)
    assert 0 < len(half["ohlcv"]) < len(resumed["ohlcv"])
    assert resumed == once
    assert run(spark, source, str(tmp_path / "out"), events.schema) == resumed
