"""Late rows of streams, batch by batch, and rows without a trade_id."""

import datetime as dt
import os

from tidemark.streaming import operators as st

SCHEMA = "symbol string, price double, quantity double, timestamp timestamp, trade_id bigint"


def at(hour: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def files(spark, folder, *batches):
    """A stream of one file a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        for f in (folder / str(i)).glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return st.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))


def test_late_rows_are_accepted_one_batch_and_then_dropped_and_counted(spark, tmp_path):
    first = [("A", 1.0, 1.0, at(10.2), 1), ("A", 2.0, 1.0, at(15), 2)]
    bars = st.ohlcv_stream(files(spark, tmp_path / "in", first, [("A", 5.0, 1.0, at(10.5), 3)], [("A", 9.0, 1.0, at(10.7), 4), ("A", 3.0, 1.0, at(17), 5)]))
    out = str(tmp_path / "out")
    q = bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.timestamp.hour: (r.open, r.close, r.high, r.volume) for r in spark.read.schema(bars.schema).parquet(out).collect()}
    assert got == {10: (1.0, 5.0, 5.0, 2.0), 15: (2.0, 2.0, 2.0, 1.0)}
    assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 1


def test_stream_rows_without_a_trade_id_are_all_kept(spark, tmp_path):
    rows = [("A", 1.0, 1.0, at(1), None), ("A", 1.0, 1.0, at(1), None), ("A", 2.0, 1.0, at(1), 7), ("A", 3.0, 1.0, at(1.1), 7), ("B", 4.0, 1.0, at(1), 7)]
    got = st.drain(st.dedupe_stream(files(spark, tmp_path / "in", rows[:3], rows[3:])), str(tmp_path / "out")).collect()
    assert sorted(r.price for r in got) == [1.0, 1.0, 2.0, 4.0]
