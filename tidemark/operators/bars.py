"""Candlesticks from trades, roll-ups, normalisation and daily metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.halo import numbered, windowed
from tidemark.schemas import INTERVALS, OHLCV

BAR = ["symbol", "interval", "timestamp", "open", "high", "low", "close", "volume"]


def _bars(trades: DataFrame, interval: str, *more: F.Column) -> DataFrame:
    order = F.struct("timestamp", "trade_id")
    bars = trades.groupBy("symbol", F.window("timestamp", INTERVALS[interval]).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), *more,
    )
    return bars.withColumns({"interval": F.lit(interval), "timestamp": F.col("w.start")}).drop("w").select(*BAR, *bars.columns[7:])


def ohlcv(trades: DataFrame, interval: str) -> DataFrame:
    """Bars of an interval; open and close by (timestamp, trade_id). No bar where there is no trade."""
    return _bars(trades, interval, F.count(F.lit(1)).alias("trades"))


def rollup_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Longer bars from shorter ones."""
    wide = bars.groupBy("symbol", F.window("timestamp", INTERVALS[interval]).alias("w")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"),
    )
    return wide.select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def normalize_klines(klines: DataFrame, version: str) -> DataFrame:
    """Incoming klines as ohlcv rows; of several versions of a bar the one with the largest version stays."""
    typed = klines.select(*[F.col(c).cast(t).alias(c) for c, t in OHLCV.types.items()], F.col(version).alias("_v"))
    rest = [c for c in OHLCV.types if c not in OHLCV.keys]
    return typed.groupBy(*OHLCV.keys).agg(F.max_by(F.struct(*rest), "_v").alias("x")).select(*OHLCV.keys, "x.*").select(BAR)


def daily_metrics(trades: DataFrame) -> DataFrame:
    """Per day and symbol: OHLC, volume, trades, vwap, return, volatility of hourly log returns, taker-buy share."""
    return daily_from_hours(hourly_sums(trades))


def hourly_sums(trades: DataFrame) -> DataFrame:
    """Hourly bars with what daily metrics add up: trades, paid and the volume that takers bought."""
    taker = F.sum(F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0))
    return _bars(trades, "1h", F.count(F.lit(1)).alias("trades"), F.sum(F.col("price") * F.col("quantity")).alias("paid"), taker.alias("taken"))


def rollup_sums(sums: DataFrame, interval: str = "1h") -> DataFrame:
    """Bars with the sums of hourly_sums(), from shorter ones."""
    more = [F.sum(c).alias(c) for c in ("trades", "paid", "taken")]
    wide = sums.groupBy("symbol", F.window("timestamp", INTERVALS[interval]).alias("w")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), *more,
    )
    return wide.withColumn("timestamp", F.col("w.start")).drop("w")


def daily_from_hours(hours: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Daily metrics of hourly_sums(), of all days or, with before, of the days that it lists.

    before: symbol, date and _last, the close of the symbol's last bar before that date or null. A day's at most 24 closes
    are gathered; only the day's first return needs a close of the day before, which is one row a day.
    """
    total = F.nullif(F.sum("volume"), F.lit(0.0))
    days = hours.groupBy("symbol", F.to_date("timestamp").alias("date")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades"),
        (F.sum("paid") / total).alias("vwap"), (F.sum("taken") / total).alias("taker_buy_share"), F.sort_array(F.collect_list(F.struct("timestamp", "close"))).alias("_hours"),
    )
    last = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    if before is None:
        days = days.withColumn("_last", last)
    else:
        days = days.join(before.select("symbol", "date", "_last"), ["symbol", "date"])
    closes = F.col("_hours.close")
    pairs = F.arrays_zip(closes.alias("x"), F.concat(F.array("_last"), F.slice(closes, 1, F.size(closes) - 1)).alias("y"))
    moves = F.array_compact(F.transform(pairs, lambda p: F.when((p["x"] > 0) & (p["y"] > 0), F.log(p["x"] / p["y"]))))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    days = days.withColumn("_moves", moves).withColumn("_mean", add(F.col("_moves")) / F.nullif(F.size("_moves"), F.lit(0)))
    spread = F.sqrt(add(F.transform("_moves", lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))) / F.nullif(F.size("_moves"), F.lit(0)))
    out = days.withColumns({"volatility": spread, "return": F.col("close") / F.nullif("_last", F.lit(0.0)) - 1})
    return out.drop("_hours", "_last", "_moves", "_mean")


def block(interval: str) -> F.Column:
    """A day of minute bars, a month of longer ones: at most 1,440 rows."""
    return F.date_trunc("day" if interval in ("1m", "5m", "15m") else "month", F.col("timestamp"))


def log_return(before: F.Column) -> F.Column:
    """Of a close to the close before; NULL where either is not positive."""
    return F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))


def log_returns(bars: DataFrame, interval: str = "1h") -> DataFrame:
    """bars with log_return to the bar before; NULL for a first bar and where a close is not positive."""
    found = windowed(numbered(bars, block(interval)), lambda w: {"log_return": log_return(F.lag("close").over(w))}, before=1)
    return found.select(*bars.columns, "log_return")
