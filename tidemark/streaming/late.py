"""Bars that late trades correct, by keyed state with event-time timers, and deduplication in which the earliest row wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.schemas import INTERVALS

DELAY, GRACE = "10 minutes", "1 day"
#: so many neighbouring bars of a symbol share a key of the state
BARS_A_KEY = 24


def _millis(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta("1 ms"))


class CorrectedBars(StatefulProcessor):
    """The bars of a symbol and block of bars: each a first time `grace` before the watermark passes its end, and a last time if late trades changed it.

    The stream's watermark lies delay and grace behind the newest trade. One timer a key stands at the next time at which a
    bar is due; a bar is forgotten when the watermark has passed its end. Trades that come after that are passed on as
    they are, of the kind `late`. A bar is kept as start, the first trade's time, id and price, high, low, the last
    trade's time, id and price, volume, the versions given and whether it has changed since.
    """

    schema = "kind string, symbol string, start bigint, open double, high double, low double, close double, volume double, version int, trade_id bigint, price double, quantity double, at bigint"
    bar = "start bigint, first bigint, first_id bigint, open double, high double, low double, last bigint, last_id bigint, close double, volume double, version int, changed boolean"

    def __init__(self, length: int, grace: int):
        self.length, self.grace = length, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bars", f"bars array<struct<{self.bar.replace(' ', ':').replace(',:', ', ')}>>")

    def end(self, start: int) -> int:
        return start // 1000 + self.length

    def bars(self) -> dict[int, tuple]:
        old = self.state.get()
        return {b[0]: tuple(b) for b in old[0]} if old is not None else {}

    def keep(self, bars: dict[int, tuple]) -> None:
        if not bars:
            self.state.clear()
            return
        self.state.update(([bars[s] for s in sorted(bars)],))
        self.handle.registerTimer(min(self.end(s) - (0 if b[10] else self.grace) for s, b in bars.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, bars, new = timerValues.getCurrentWatermarkInMs(), self.bars(), False
        for df in rows:
            over = df.start // 1000 + self.length <= watermark
            if over.any():
                late = df[over]
                empty = dict.fromkeys(("open", "high", "low", "close", "volume", "version"))
                yield pd.DataFrame({"kind": "late", "symbol": key[0], "start": late.start, **empty, "trade_id": late.trade_id.astype("Int64"), "price": late.price, "quantity": late.quantity, "at": late["at"]})
            df = df[~over]
            df = df.assign(_id=df.trade_id.astype("Int64").fillna(-1)).sort_values(["at", "_id"])
            for start, part in df.groupby("start"):
                a, b = part.iloc[0], part.iloc[-1]
                first, last = (int(a["at"]), int(a._id), float(a.price)), (int(b["at"]), int(b._id), float(b.price))
                high, low, volume, version, new = float(part.price.max()), float(part.price.min()), float(part.quantity.sum()), 0, True
                if (old := bars.get(int(start))) is not None:
                    first, last, version = min(first, old[1:4]), max(last, old[6:9]), old[10]
                    high, low, volume = max(high, old[4]), min(low, old[5]), volume + old[9]
                bars[int(start)] = (int(start), *first, high, low, *last, volume, version, True)
        if new:
            self.keep(bars)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, left, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for start, b in self.bars().items():
            final, due = watermark >= self.end(start), b[10] == 0 and watermark >= self.end(start) - self.grace
            if b[11] and (final or due):
                out.append({"kind": "bar", "symbol": key[0], "start": start, "open": b[3], "high": b[4], "low": b[5], "close": b[8], "volume": b[9], "version": b[10] + 1, "trade_id": None, "price": None, "quantity": None, "at": None})
                b = (*b[:10], b[10] + 1, False)
            if not final:
                left[start] = b
        self.keep(left)
        if out:
            yield pd.DataFrame(out).astype({"trade_id": "Int64", "at": "Int64", "price": "float64", "quantity": "float64"})

    def close(self) -> None:
        pass


def corrected_bars(trades: DataFrame, interval: str = "1h", delay: str = DELAY, grace: str = GRACE) -> DataFrame:
    """A stream of bars and of trades that came too late for theirs, told apart by `kind`.

    trades: a stream without a watermark. A bar comes once its end is older than the newest trade by the delay, as version
    1; if trades come for it until the grace has passed too, it comes once more then, as the next version. A trade that
    comes after that comes out as it is, of the kind `late`. Nothing is dropped.
    """
    both = trades.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", f"{_millis(delay) + _millis(grace)} milliseconds")
    # the time goes on as a number, so that late rows are not dropped on the way to the state
    rows = both.withColumn("start", F.unix_micros(F.window("timestamp", INTERVALS[interval])["start"])).select("symbol", "start", "trade_id", "price", "quantity", F.unix_micros("timestamp").alias("at"))
    rows = rows.withColumn("block", F.floor(F.col("start") / (BARS_A_KEY * 1000 * _millis(INTERVALS[interval]))))
    found = rows.groupBy("symbol", "block").transformWithStateInPandas(CorrectedBars(_millis(INTERVALS[interval]), _millis(grace)), CorrectedBars.schema, "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c)
    return found.select("kind", "symbol", F.lit(interval).alias("interval"), time("start").alias("timestamp"), "open", "high", "low", "close", "volume", "version", "trade_id", "price", "quantity", time("at").alias("traded_at"))


def last_versions(rows: DataFrame) -> DataFrame:
    """The last version of each bar among the rows of corrected_bars()."""
    cols = ["open", "high", "low", "close", "volume", "version"]
    bars = rows.filter("kind = 'bar'").groupBy("symbol", "interval", "timestamp").agg(F.max_by(F.struct(*cols), "version").alias("b"))
    return bars.select("symbol", "interval", "timestamp", *[f"b.{c}" for c in cols])


def late_trades(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'late'").select("symbol", "price", "quantity", F.col("traded_at").alias("timestamp"), "trade_id")


def earliest_trades(trades: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row for each (symbol, trade_id), the earliest by (timestamp, price, quantity) as in the batch; the source is read once.

    Rows of an id that follow each other within the delay are one session, whose earliest row is given once the watermark
    has passed the last by the delay; a repeat that comes later than that is dropped as late. Rows without a trade_id are
    sessions of their own, so all of them pass.
    """
    cols = trades.columns
    both = trades.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    rows = both.withColumn("_own", F.when(F.col("trade_id").isNull(), F.expr("uuid()")))
    first = F.min_by(F.struct(*cols), F.struct("timestamp", "price", "quantity")).alias("x")
    return rows.groupBy("symbol", "trade_id", "_own", F.session_window("timestamp", delay)).agg(first).select("x.*")
