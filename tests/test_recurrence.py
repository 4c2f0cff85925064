"""The block scan against plain recursion, where powers would overflow and where values are missing."""

import datetime as dt
import math

import pytest

from tidemark.operators import indicators


def recursion(values, a):
    out = []
    for x in values:
        out.append(x if not out else a * x + (1 - a) * out[-1])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_ema_of_two_days_of_minutes(spark, n):
    start = dt.datetime(2024, 1, 1)
    close = [None if i % 97 == 5 else 100 + math.sin(i / 7) * 3 + i % 11 for i in range(2_880)]
    rows = [("A", start + dt.timedelta(minutes=i), x) for i, x in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double")
    got = [r[f"ema_{n}"] for r in indicators.ema(bars, n, "1m").orderBy("timestamp").collect()]
    want = recursion([x for x in close if x is not None], 2 / (n + 1))
    assert len(got) == len(want) and all(abs(x - y) < 1e-9 for x, y in zip(got, want))


def test_rsi_leaves_out_bars_without_a_close(spark):
    start = dt.datetime(2024, 1, 1)
    close = [None if i in (0, 9, 30) else 100 + math.sin(i) * 2 for i in range(60)]
    bars = spark.createDataFrame([("A", start + dt.timedelta(hours=i), x) for i, x in enumerate(close)], "symbol string, timestamp timestamp, close double")
    got = [r.rsi_14 for r in indicators.rsi(bars).orderBy("timestamp").collect()]
    known = [x for x in close if x is not None]
    moves = [0.0] + [b - a for a, b in zip(known, known[1:])]
    up, down = recursion([max(m, 0) for m in moves], 1 / 14), recursion([max(-m, 0) for m in moves], 1 / 14)
    want = [None if i < 13 else 100.0 if not d else 100 - 100 / (1 + u / d) for i, (u, d) in enumerate(zip(up, down))]
    assert got[:13] == [None] * 13 and all(abs(x - y) < 1e-9 for x, y in zip(got[13:], want[13:]))
