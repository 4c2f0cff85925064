"""The earliest of the repeats in a batch passes, in whatever order tasks send them."""

import datetime as dt

import pytest

from tidemark.streaming import operators as st

SCHEMA = "symbol string, price double, quantity double, timestamp timestamp, trade_id bigint"


def trades(spark, folder, rows, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return st.with_event_time(spark.readStream.schema(SCHEMA).parquet(folder))


@pytest.mark.parametrize("files", [1, 3])
def test_earliest_of_a_batch(spark, tmp_path, files):
    start = dt.datetime(2024, 1, 1)
    first = [("A", 1.0, float(i), start + dt.timedelta(seconds=i), i if i % 5 else None) for i in range(40)]
    later = [(s, 2.0, q, t + dt.timedelta(seconds=1), i) for s, _, q, t, i in first]
    got = st.drain(st.dedupe_stream(trades(spark, str(tmp_path / "in"), later[::-1] + first[::-1], files)), str(tmp_path / "out")).collect()
    assert sorted((r.price, r.quantity) for r in got) == sorted([(1.0, r[2]) for r in first] + [(2.0, r[2]) for r in later if r[4] is None])
