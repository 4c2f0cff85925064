"""Latest rows, time ranges and recent rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import OHLCV


def latest(df: DataFrame, time: str = "timestamp", key: str = "symbol", tie: str | None = None) -> DataFrame:
    """The last row of each key: a grouped maximum, no sort."""
    order = F.struct(time, tie) if tie else F.col(time)
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("x")).select("x.*")


def bars_range(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """A symbol's bars of a time range, newest first."""
    t = F.col("timestamp")
    return bars.filter((F.col("symbol") == symbol) & (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))).orderBy(F.desc("timestamp"))


def stored_bars(spark: SparkSession, path: str, interval: str, symbol: str, start: str, end: str) -> DataFrame:
    """A symbol's bars of a time range [start, end) from a table in folders by interval and date, newest first.

    The folders of other intervals and days are not listed or read; of those that are, sorted files, row groups and
    pages of other symbols and times are left out.
    """
    first, last = (dt.datetime.fromisoformat(t).date() for t in (start, end))
    schema = T.StructType([*OHLCV.schema.fields, T.StructField("date", T.DateType())])
    rows = spark.read.schema(schema).parquet(path).filter((F.col("interval") == interval) & F.col("date").between(F.lit(first), F.lit(last)))
    return bars_range(rows.repartition("timestamp"), symbol, start, end).drop("date")  # dealt once, or each sampling of the sort reads the files again


def recent(df: DataFrame, time: str, n: int, symbol: str | None = None, *ties: str) -> DataFrame:
    """The n newest rows, of one symbol where given."""
    rows = df if symbol is None else df.filter(F.col("symbol") == symbol)
    return rows.orderBy(F.desc(time), *ties).limit(n)
