"""Price and volume alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.halo import numbered, windowed
from tidemark.operators.bars import block, log_return
from tidemark.schemas import INTERVALS

#: kind of alert -> the column that it watches
WATCHED = {"price": "log_return", "volume": "volume"}


def _alerts(bars: DataFrame, kinds: tuple[str, ...], n: int, k: float, interval: str) -> DataFrame:
    """Alerts of the kinds, from one pass over the bars; a chunk of a symbol borrows the n + 1 bars before it."""

    def scores(every) -> dict[str, F.Column]:
        w, out = every.rowsBetween(-n, -1), {}
        for kind in kinds:
            x = F.col(WATCHED[kind])
            mean, dev = F.avg(x).over(w), F.stddev_pop(x).over(w)
            score = F.when((F.count(x).over(w) == n) & (dev > 0), (x - mean) / F.nullif(dev, F.lit(0.0)))
            out[f"_{kind}"] = F.struct(F.lit(kind).alias("kind"), x.alias("value"), score.alias("score"))
        return out

    returns = lambda every: {"log_return": log_return(F.lag("close").over(every))} if "price" in kinds else {}
    found = windowed(numbered(bars, block(interval)), returns, scores, before=n + 1)
    scored = found.select("symbol", "timestamp", F.inline(F.array(*[f"_{kind}" for kind in kinds]))).filter(F.abs("score") >= k)
    end = F.col("timestamp") + F.expr(f"INTERVAL {INTERVALS[interval]}")
    return scored.select("symbol", end.alias("detected_at"), "kind", "value", "score", F.lit(float(k)).alias("threshold"))


def price_alerts(bars: DataFrame, n: int = 20, k: float = 3.0, interval: str = "1h") -> DataFrame:
    """Bars whose log return lies k deviations from the mean of the n bars before."""
    return _alerts(bars, ("price",), n, k, interval)


def volume_spikes(bars: DataFrame, n: int = 20, k: float = 3.0, interval: str = "1h") -> DataFrame:
    return _alerts(bars, ("volume",), n, k, interval)


def anomalies(bars: DataFrame, n: int = 20, k: float = 3.0, interval: str = "1h") -> DataFrame:
    return _alerts(bars, tuple(WATCHED), n, k, interval)
