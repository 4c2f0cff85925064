"""Technical indicators of one interval's bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.halo import numbered, windowed
from tidemark.functions.recurrence import ewm
from tidemark.operators.bars import block
from tidemark.schemas import INDICATOR_COLUMNS


def _bands(n: int, k: float):
    """sma_n and the bands, over a window that looks back n - 1 bars."""

    def step(every) -> dict[str, F.Column]:
        w = every.rowsBetween(1 - n, 0)
        full = F.count("close").over(w) == n
        mean, dev = F.when(full, F.avg("close").over(w)), F.when(full, F.stddev_pop("close").over(w))
        return {f"sma_{n}": mean, "bollinger_upper": mean + k * dev, "bollinger_lower": mean - k * dev}

    return step


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, interval: str = "1h") -> DataFrame:
    """bars with sma_n and the bands; NULL before the n-th bar."""
    found = windowed(numbered(bars, block(interval)), _bands(n, k), before=n - 1)
    return found.select(*bars.columns, f"sma_{n}", "bollinger_upper", "bollinger_lower")


def ema(bars: DataFrame, n: int = 12, interval: str = "1h") -> DataFrame:
    """bars with ema_n; bars without a close are left out."""
    return ewm(bars, {f"ema_{n}": ("close", 2 / (n + 1))}, block(interval))


def _signal(average: str, span: int, signal: int) -> F.Column:
    """The average over `signal` of an average over another span, from both averages of the same closes.

    The two scans in a row come apart into partial fractions; both start at the first close.
    """
    a, b = 2 / (span + 1), 2 / (signal + 1)
    q, p = 1 - a, 1 - b
    return (a * p * F.col("_signal") - b * q * F.col(average)) / (p - q)


def _moves(every) -> dict[str, F.Column]:
    """The rises and falls from the bar before and the bar's number, from 1."""
    move = F.coalesce(F.col("close") - F.lag("close").over(every), F.lit(0.0))
    return {"_up": F.greatest(move, F.lit(0.0)), "_down": F.greatest(-move, F.lit(0.0)), "_row": F.col("_rn") + 1}


def _rsi(n: int) -> F.Column:
    value = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))))
    return F.when(F.col("_row") >= n, value)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, interval: str = "1h") -> DataFrame:
    """bars with ema_fast, macd and macd_signal; bars without a close are left out.

    Where the span of the signal is one of the other two, the signal takes a scan of its own over macd.
    """
    spans = {f"ema_{fast}": fast, "_slow": slow} | ({} if signal in (fast, slow) else {"_signal": signal})
    averages = ewm(bars, {name: ("close", 2 / (n + 1)) for name, n in spans.items()}, block(interval))
    lines = averages.withColumn("macd", F.col(f"ema_{fast}") - F.col("_slow"))
    if signal in (fast, slow):
        return ewm(lines, {"macd_signal": ("macd", 2 / (signal + 1))}, block(interval)).drop("_slow")
    return lines.withColumn("macd_signal", _signal(f"ema_{fast}", fast, signal) - _signal("_slow", slow, signal)).drop("_slow", "_signal")


def rsi(bars: DataFrame, n: int = 14, interval: str = "1h") -> DataFrame:
    """bars with rsi_n by Wilder's averages; 100 where there is no loss, NULL for the first n - 1 bars.

    Bars without a close are left out.
    """
    moved = windowed(numbered(bars.filter("close is not null"), block(interval)), _moves, before=1)
    both = ewm(moved, {"_gain": ("_up", 1 / n), "_loss": ("_down", 1 / n)}, F.col("_chunk"))
    return both.withColumn(f"rsi_{n}", _rsi(n)).select(*bars.columns, f"rsi_{n}")


def with_indicators(bars: DataFrame, interval: str = "1h", *steps, before: int = 0, after: int = 0) -> DataFrame:
    """bars with all indicator columns, from one scan of five averages. Bars without a close are left out.

    steps give further columns from the same windows, as in functions.halo.windowed.
    """
    averages = {"ema_12": ("close", 2 / 13), "_slow": ("close", 2 / 27), "_signal": ("close", 2 / 10), "_gain": ("_up", 1 / 14), "_loss": ("_down", 1 / 14)}
    rows = numbered(bars.filter("close is not null"), block(interval))
    moved = windowed(rows, *steps, _moves, _bands(20, 2.0), before=max(19, before), after=after)
    line, smooth = F.col("ema_12") - F.col("_slow"), _signal("ema_12", 12, 9) - _signal("_slow", 26, 9)
    own = {"_up", "_down", "_row", "_rn", "_chunk", *INDICATOR_COLUMNS}
    out = ewm(moved, averages, F.col("_chunk")).withColumns({"rsi_14": _rsi(14), "macd": line, "macd_signal": smooth})
    return out.select(*[c for c in moved.columns if c not in own], *INDICATOR_COLUMNS)


def indicators(bars: DataFrame, interval: str = "1h") -> DataFrame:
    """The indicator row of each bar. Bars without a close are left out."""
    return with_indicators(bars.select("symbol", "interval", "timestamp", "close"), interval).drop("close")
