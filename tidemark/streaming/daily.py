"""Daily metrics kept up to date by batches of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.bars import daily_from_hours, rollup_sums
from tidemark.sources.writers import exists, upsert

DAILY = "symbol string, date date, close double"


def refresh_daily(batch: DataFrame, folder: str) -> None:
    """Merge a batch of bars with sums into folder/sums and make the days that it changes anew in folder/daily_metrics.

    Those are the days of its bars and, of each symbol, the day that follows one of them, whose return and first hourly
    return begin at the changed close. Only these days' bars are read; of the other days only the table of one row a day
    and symbol is. A repeated batch changes nothing.
    """
    spark = batch.sparkSession
    touched = [r.date for r in batch.select(F.to_date("timestamp").alias("date")).distinct().collect()]  # days of one batch
    if not touched:
        return
    upsert(batch, f"{folder}/sums", ["symbol", "timestamp"])
    sums, here = spark.read.parquet(f"{folder}/sums"), F.col("date").isin(touched)
    closes = sums.filter(here).groupBy("symbol", "date").agg(F.max_by("close", "timestamp").alias("close"))
    if exists(spark, f"{folder}/daily_metrics"):
        closes = closes.unionByName(spark.read.parquet(f"{folder}/daily_metrics").filter(~here).select("symbol", "date", "close"))
    by = W.partitionBy("symbol").orderBy("date")  # a row a day
    chain = closes.withColumns({"_last": F.lag("close").over(by), "_day": F.lag("date").over(by)})
    changed = chain.filter(here | F.col("_day").isin(touched)).select("symbol", "date", "_last").persist()
    days = [r.date for r in changed.select("date").distinct().collect()]
    made = daily_from_hours(rollup_sums(sums.filter(F.col("date").isin(days)).drop("date")), changed)
    upsert(made, f"{folder}/daily_metrics", ["symbol", "date"], time="date")
    changed.unpersist()
