"""Bars corrected by late trades, and the earliest of repeated rows, batch by batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.quality import dedupe_trades
from tidemark.streaming import late
from tidemark.streaming import operators as st

SCHEMA = "symbol string, price double, quantity double, timestamp timestamp, trade_id bigint, is_buyer_maker boolean"


def at(hour: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def feed(spark, tmp_path, make, *batches):
    """What the stream gives for each batch, one run a batch over one checkpoint."""
    source, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out.append(st.drain(make(spark.readStream.schema(SCHEMA).parquet(source)), str(tmp_path / "out")).collect())
    return out


def trade(hour, price, i, symbol="A", quantity=1.0):
    return (symbol, float(price), quantity, at(hour), i, True)


def test_a_bar_is_corrected_and_later_trades_are_kept_aside(spark, tmp_path):
    make = lambda s: late.corrected_bars(s, "1h", "10 minutes", "3 hours")
    a, b, c = feed(
        spark, tmp_path, make,
        [trade(1.2, 10, 1), trade(1.8, 12, 2), trade(2.5, 20, 3), trade(4.5, 30, 4)],  # newest 4:30, watermark 1:20: bars 1 and 2 are out, none is final
        [trade(1.1, 8, 5), trade(1.9, 15, 6), trade(1.5, 50, 7, "B"), trade(7.9, 40, 8)],  # late for 1, corrected when 7:54 - 3:10 passes 2:00
        [trade(1.3, 1, 9), trade(2.6, 25, None), trade(7.95, 41, 10)],  # 1 is final: late; 2 and 4 are final too
    )
    shown = lambda rows: sorted((r.kind, r.symbol, r.timestamp.hour, r.version or 0, r.open or 0, r.high or 0, r.low or 0, r.close or 0, r.volume or 0) for r in rows)
    assert shown(a) == [("bar", "A", 1, 1, 10, 12, 10, 12, 2), ("bar", "A", 2, 1, 20, 20, 20, 20, 1)]
    # the newest is 7:54 now: 4 is out, 1 is final with its late trades, 2 is final and unchanged
    assert shown(b) == sorted([*shown(a), ("bar", "A", 1, 2, 8, 15, 8, 15, 4), ("bar", "A", 4, 1, 30, 30, 30, 30, 1), ("bar", "B", 1, 1, 50, 50, 50, 50, 1)])
    last = {(r.symbol, r.timestamp.hour): (r.version, r.open, r.high, r.low, r.close, r.volume) for r in late.last_versions(spark.createDataFrame(c, spark.read.parquet(str(tmp_path / "out/out")).schema)).collect()}
    assert last["A", 1] == (2, 8.0, 15.0, 8.0, 15.0, 4.0) and last["A", 2] == (1, 20.0, 20.0, 20.0, 20.0, 1.0)
    assert last["B", 1][1:] == (50.0, 50.0, 50.0, 50.0, 1.0) and last["A", 4][0] == 1
    aside = [(r.trade_id, r.price, r.quantity, r.traded_at) for r in c if r.kind == "late"]
    assert sorted(aside, key=str) == sorted([(9, 1.0, 1.0, at(1.3)), (None, 25.0, 1.0, at(2.6))], key=str)
    assert all(r.version is None and r.open is None for r in c if r.kind == "late")


def test_earliest_of_repeats_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        hour = rng.uniform(0, 10)
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((rng.choice("AB"), rng.choice([1.0, 2.0, None]), 1.0, at(hour + rng.uniform(0, 0.1)), i if i % 9 else None, rng.choice([True, None])))
    rows.append(("Z", 1.0, 1.0, at(11), 999, True))
    rng.shuffle(rows)
    (got,) = feed(spark, tmp_path, late.earliest_trades, rows)
    want = dedupe_trades(spark.createDataFrame(rows, SCHEMA)).filter(F.col("symbol") != "Z").collect()
    key = lambda r: repr((r.symbol, r.trade_id, r.timestamp, r.price, r.quantity))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 100


def test_a_repeat_in_a_later_batch_is_dropped(spark, tmp_path):
    rows = [trade(1, 1, 1), trade(3, 2, 2)], [trade(1.05, 9, 1), trade(2.95, 7, 2), trade(5, 3, 3)]
    a, b = feed(spark, tmp_path, late.earliest_trades, *rows)
    assert [(r.trade_id, r.price) for r in a] == [(1, 1.0)]
    assert sorted((r.trade_id, r.price) for r in b) == [(1, 1.0), (2, 7.0)]  # the earlier row of 2 was in time
