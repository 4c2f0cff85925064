"""Hand-made cases of the batch operators: validation, deduplication, bars, indicators, alerts, retention."""

import datetime as dt

import pytest

from tidemark.operators import anomalies, bars, forecast, indicators, quality
from tidemark.schemas import TRADES
from tidemark.sources import readers, writers

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, price double, quantity double, timestamp timestamp_ntz, trade_id bigint, is_buyer_maker boolean"


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def hourly(spark, closes, symbol="A", first=0, step=1):
    rows = [(symbol, "1h", START + dt.timedelta(hours=first + step * i), float(c), 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp_ntz, close double, volume double")


def test_required_fields_and_types(spark):
    rows = [("A", "1.5", 1.0, START, None), (None, "1.5", 1.0, START, 1), ("A", None, 1.0, START, 2), ("A", "1", None, START, 3), ("A", "1", 1.0, None, 4), ("A", "dear", 1.0, START, 5)]
    df = spark.createDataFrame(rows, "symbol string, price string, quantity double, timestamp timestamp_ntz, trade_id bigint")
    ok, bad = quality.validate(df, TRADES)
    assert [(r.price, r.trade_id) for r in ok.collect()] == [(1.5, None)] and dict(ok.dtypes)["price"] == "double"
    assert {r.trade_id: r.reasons for r in bad.collect()} == {1: ["symbol: missing"], 2: ["price: missing"], 3: ["quantity: missing"], 4: ["timestamp: missing"], 5: ["price: type"]}
    none, all_bad = quality.validate(df.drop("symbol"), TRADES)
    assert none.isEmpty() and all("symbol: missing" in r.reasons for r in all_bad.collect())


def test_extra_and_optional_fields_and_odd_numbers(spark):
    df = spark.createDataFrame([("A", -1.0, 0.0, START, "x")], "symbol string, price double, quantity double, timestamp timestamp_ntz, venue string")
    ok, bad = quality.validate(df, TRADES)
    assert ok.first().venue == "x" and bad.isEmpty()


def test_earliest_of_repeated_trades(spark):
    rows = [("A", 2.0, 1.0, at(5), 1, True), ("A", 1.0, 1.0, at(3), 1, True), ("B", 3.0, 1.0, at(9), 1, True), ("A", 4.0, 1.0, at(1), None, True), ("A", 4.0, 1.0, at(1), None, True)]
    got = quality.dedupe_trades(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.price for r in got) == [1.0, 3.0, 4.0, 4.0]


def test_bar_edges_ties_and_single_trades(spark):
    rows = [("A", 5.0, 1.0, at(59.5), 9, True), ("A", 7.0, 2.0, at(60), 3, True), ("A", 8.0, 1.0, at(60), 2, False), ("A", 6.0, 1.0, at(60), 4, False)]
    got = bars.ohlcv(spark.createDataFrame(rows, SCHEMA), "1h").orderBy("timestamp").collect()
    assert [(r.timestamp, r.open, r.high, r.low, r.close, r.volume, r.trades) for r in got] == [(at(0), 5.0, 5.0, 5.0, 5.0, 1.0, 1), (at(60), 8.0, 8.0, 6.0, 6.0, 4.0, 3)]


def test_daily_metrics_of_a_worked_series(spark):
    rows = [("A", 10.0, 1.0, at(1), 1, True), ("A", 20.0, 3.0, at(61), 2, False), ("A", 30.0, 2.0, at(24 * 60 + 5), 3, False), ("B", 1.0, 0.0, at(2), 4, True)]
    got = {(r.symbol, r.date.day): r for r in bars.daily_metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    first, second, other = got["A", 1], got["A", 2], got["B", 1]
    assert (first.open, first.high, first.low, first.close, first.volume, first.trades) == (10, 20, 10, 20, 4, 2)
    assert first.vwap == 17.5 and first.taker_buy_share == 0.75 and first["return"] is None and first.volatility == 0.0
    assert second["return"] == 0.5 and second.vwap == 30 and other.vwap is None and other.taker_buy_share is None and other.volatility is None


def test_twentieth_bar_constant_closes_and_the_first_bar(spark):
    got = indicators.indicators(hourly(spark, [50] * 20)).orderBy("timestamp").collect()
    assert [r.sma_20 for r in got] == [None] * 19 + [50.0]
    assert got[-1].bollinger_upper == got[-1].bollinger_lower == 50.0
    assert [r.rsi_14 for r in got] == [None] * 13 + [100.0] * 7
    assert got[0].ema_12 == 50.0 and abs(got[0].macd) < 1e-12 and abs(got[0].macd_signal) < 1e-12
    assert anomalies.anomalies(hourly(spark, [50] * 40)).isEmpty()


def test_falling_closes_and_a_close_that_is_not_positive(spark):
    got = indicators.rsi(hourly(spark, range(100, 70, -1))).orderBy("timestamp").collect()
    assert all(abs(r.rsi_14) < 1e-9 for r in got[13:])
    closes = [100 + i % 3 for i in range(30)] + [0, -5, 101]
    moves = [r.log_return for r in bars.log_returns(hourly(spark, closes)).orderBy("timestamp").collect()]
    assert moves[0] is None and moves[30:] == [None, None, None] and None not in moves[1:30]
    assert anomalies.price_alerts(hourly(spark, closes)).isEmpty()


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_indicators_equal_recursion_over_gaps_and_months(spark, parts):
    closes = [100 + (i * 37 % 23) - (i * i % 7) for i in range(60)]
    both = hourly(spark, closes, "A", step=50).union(hourly(spark, closes[:25], "B", first=700))  # A spans four months
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r.symbol, r.timestamp): r for r in indicators.indicators(both).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for symbol, values, first, step in (("A", closes, 0, 50), ("B", closes[:25], 700, 1)):
        fast = slow = values[0]
        signal = gain = loss = 0.0
        for i, x in enumerate(values):
            move = x - values[i - 1] if i else 0.0
            if i:
                fast, slow = fast + 2 / 13 * (x - fast), slow + 2 / 27 * (x - slow)
                signal += 0.2 * (fast - slow - signal)
                gain, loss = gain + (max(move, 0) - gain) / 14, loss + (max(-move, 0) - loss) / 14
            r = got[symbol, START + dt.timedelta(hours=first + step * i)]
            assert abs(r.ema_12 - fast) < 1e-9 and abs(r.macd - (fast - slow)) < 1e-9 and abs(r.macd_signal - signal) < 1e-9
            assert r.rsi_14 is None if i < 13 else abs(r.rsi_14 - (100 if not loss else 100 - 100 / (1 + gain / loss))) < 1e-9
    assert len(got) == 85


def test_macd_alone_equals_the_indicator_row(spark):
    df = hourly(spark, [100 + i % 7 for i in range(40)])
    a = [(r.macd, r.macd_signal) for r in indicators.macd(df).orderBy("timestamp").collect()]
    b = [(r.macd, r.macd_signal) for r in indicators.indicators(df).orderBy("timestamp").collect()]
    assert all(abs(x - y) < 1e-9 for p, q in zip(a, b) for x, y in zip(p, q))


def test_features_and_alerts(spark):
    closes = [100 + i % 2 for i in range(25)] + [160]
    rows = forecast.features(hourly(spark, closes)).orderBy("timestamp").collect()
    assert [rows[5][f"close_lag_{i}"] for i in (1, 2, 3)] == [100.0, 101.0, 100.0] and rows[5].label == 100.0 and rows[-1].label is None and rows[5].hour == 5
    found = anomalies.anomalies(hourly(spark, closes)).collect()
    assert [(r.kind, r.detected_at, r.threshold) for r in found] == [("price", START + dt.timedelta(hours=26), 3.0)] and found[0].score > 3


def test_malformed_messages_are_set_aside(spark):
    texts = ['{"symbol":"A","price":1.0}', "{", "", "no json", None]
    rows, bad = readers.read_messages(spark.createDataFrame([(t,) for t in texts], "value string"), TRADES)
    assert [r.price for r in rows.collect()] == [1.0]
    assert sorted(r[0] for r in bad.collect()) == ["", "", "no json", "{"]


def test_upsert_replaces_repeats_and_drops_expired_days(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["symbol", "timestamp"]
    rows = lambda *x: spark.createDataFrame([("A", START + dt.timedelta(days=d), v) for d, v in x], "symbol string, timestamp timestamp_ntz, v double")
    read = lambda: sorted((r.timestamp.day, r.v) for r in spark.read.parquet(path).collect())
    for _ in range(2):
        writers.upsert(rows((0, 1.0), (1, 2.0), (8, 3.0)), path, keys)
    writers.upsert(rows((1, 5.0)), path, keys)
    assert read() == [(1, 1.0), (2, 5.0), (9, 3.0)] and not (tmp_path / "t_staging").exists()
    assert writers.drop_expired(spark, path, "7 days", dt.datetime(2024, 1, 9, 12)) == [dt.date(2024, 1, 1)]
    assert read() == [(2, 5.0), (9, 3.0)]
    assert writers.drop_expired(spark, path, "7 days", dt.datetime(2024, 1, 10)) == [dt.date(2024, 1, 2)]
    assert writers.drop_expired(spark, str(tmp_path / "none"), "7 days", START) == []
