"""Windows over chunks with a halo against windows over whole symbols, and plans without a task for a whole symbol."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.halo import numbered, windowed
from tidemark.operators import anomalies, bars, forecast, indicators

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, interval string, timestamp timestamp_ntz, close double, volume double"


@pytest.fixture(scope="module")
def series(spark):
    """Symbols with gaps of days, a null symbol, one with a single bar, closes that are null, zero and negative."""
    rng, rows = np.random.default_rng(3), []
    for symbol, n in (("A", 400), ("B", 41), (None, 30), ("C", 1), ("D", 3)):
        at = np.cumsum(rng.choice([1, 1, 1, 2, 300], n))
        for i in range(n):
            close = None if rng.random() < 0.04 else float(rng.choice([0.0, -3.0])) if rng.random() < 0.02 else float(np.round(100 + rng.normal(), 3))
            rows.append((symbol, "1h", START + dt.timedelta(hours=int(at[i])), close, float(rng.integers(0, 50))))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA).cache()


def same(a, b):
    """Equal rows, doubles within rounding."""
    key = lambda r: tuple((x is not None, x) for x in r if not isinstance(x, float))
    x, y = sorted(map(tuple, a.collect()), key=lambda r: repr(key(r))), sorted(map(tuple, b.select(*a.columns).collect()), key=lambda r: repr(key(r)))
    assert len(x) == len(y)
    for p, q in zip(x, y):
        assert all((u is None) == (v is None) and (u is None or u == v or abs(u - v) < 1e-9) for u, v in zip(p, q)), (p, q)


@pytest.mark.parametrize("chunk, before, after", [(1, 1, 1), (3, 3, 2), (7, 0, 5), (7, 5, 0), (64, 20, 1), (5, 9, 9)])
def test_any_chunk_gives_the_windows_of_the_whole_key(spark, series, chunk, before, after):
    whole = W.partitionBy("symbol").orderBy("timestamp")
    columns = lambda w: {"s": F.sum("volume").over(w.rowsBetween(-before, after)), "l": F.lag("volume", before).over(w), "d": F.lead("volume", after).over(w)}
    got = windowed(numbered(series, F.date_trunc("day", "timestamp")), columns, before=before, after=after, chunk=chunk)
    want = series.withColumns(columns(whole) | {"_rn": F.row_number().over(whole) - 1})
    same(got.select("symbol", "timestamp", "s", "l", "d", "_rn"), want)


def test_numbers_of_repeated_times_and_of_rows_without_a_time(spark):
    rows = [("A", None), ("A", START), ("A", START), ("A", START + dt.timedelta(days=40)), ("B", None), ("B", None)]
    got = numbered(spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz"), F.date_trunc("month", "timestamp")).collect()
    assert sorted(r._rn for r in got if r.symbol == "A") == [0, 1, 2, 3] and sorted(r._rn for r in got if r.symbol == "B") == [0, 1]
    assert {r._rn: r.timestamp for r in got if r.symbol == "A"}[0] is None
    assert numbered(spark.createDataFrame([], "symbol string, timestamp timestamp_ntz"), F.date_trunc("month", "timestamp")).collect() == []


def old_alerts(df, n=20, k=3.0):
    order = W.partitionBy("symbol").orderBy("timestamp")
    before, w, found = F.lag("close").over(order), order.rowsBetween(-n, -1), []
    df = df.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))
    for kind, c in (("price", "log_return"), ("volume", "volume")):
        dev = F.stddev_pop(c).over(w)
        score = F.when((F.count(c).over(w) == n) & (dev > 0), (F.col(c) - F.avg(c).over(w)) / F.nullif(dev, F.lit(0.0)))
        found.append(df.select("symbol", (F.col("timestamp") + F.expr("interval 1 hour")).alias("detected_at"), F.lit(kind).alias("kind"), F.col(c).alias("value"), score.alias("score"), F.lit(k).alias("threshold")).filter(F.abs("score") >= k))
    return found[0].union(found[1])


def test_operators_equal_windows_over_whole_symbols(spark, series):
    order = W.partitionBy("symbol").orderBy("timestamp")
    w = order.rowsBetween(-19, 0)
    full = F.count("close").over(w) == 20
    mean, dev = F.when(full, F.avg("close").over(w)), F.when(full, F.stddev_pop("close").over(w))
    same(indicators.bollinger(series).drop("volume", "close"), series.withColumns({"sma_20": mean, "bollinger_upper": mean + 2 * dev, "bollinger_lower": mean - 2 * dev}))
    small = series.withColumn("volume", F.when(F.col("volume") > 48, 400.0).otherwise(F.col("volume")))
    assert old_alerts(small).count() > 0
    same(anomalies.anomalies(small), old_alerts(small))
    before = F.lag("close").over(order)
    same(bars.log_returns(series).select("symbol", "timestamp", "log_return"), series.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))))
    label = forecast.naive(series).select("symbol", "target_time", "label")
    same(label, series.select("symbol", (F.col("timestamp") + F.expr("interval 1 hour")).alias("target_time"), F.lead("close").over(order).alias("label")))


@pytest.mark.parametrize("make", [indicators.bollinger, indicators.rsi, indicators.indicators, anomalies.anomalies, anomalies.volume_spikes, forecast.features, bars.log_returns, forecast.naive])
def test_no_window_is_dealt_by_symbol_alone(spark, series, make):
    plan = make(series)._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(((?:[a-zA-Z_]+#\d+L?, )+)", plan)
    assert specs and all(len(s.strip(", ").split(", ")) >= 2 for s in specs), specs


def test_signal_of_the_same_span_as_another(spark):
    closes = [100 + (i * 37 % 23) for i in range(50)]
    df = spark.createDataFrame([("A", "1h", START + dt.timedelta(hours=i), float(c), 1.0) for i, c in enumerate(closes)], SCHEMA)
    for signal in (12, 26):
        got = [r.macd_signal for r in indicators.macd(df, signal=signal).orderBy("timestamp").collect()]
        fast = slow = closes[0]
        line = 0.0
        for i, x in enumerate(closes):
            fast, slow = fast + 2 / 13 * (x - fast), slow + 2 / 27 * (x - slow)
            line = fast - slow if i == 0 else line + 2 / (signal + 1) * (fast - slow - line)
            assert abs(got[i] - line) < 1e-9
