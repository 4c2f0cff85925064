"""Features, price models, predictions and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.halo import numbered, windowed
from tidemark.operators.bars import block, log_return
from tidemark.operators.indicators import with_indicators
from tidemark.schemas import INDICATOR_COLUMNS, INTERVALS


def features(bars: DataFrame, lags: int = 3, interval: str = "1h", label_time: bool = False) -> DataFrame:
    """Lagged closes, the log return, the indicators, the hour, and the next close as label, from one pass over the bars.

    Bars without a close are left out before. label_time adds label_at, the end of the bar that the label is of.
    """
    lagged = [f"close_lag_{i}" for i in range(1, lags + 1)]

    def step(w) -> dict[str, F.Column]:
        found = {c: F.lag("close", i).over(w) for i, c in enumerate(lagged, 1)}
        at = {"label_at": F.lead("timestamp").over(w) + F.expr(f"INTERVAL {INTERVALS[interval]}")} if label_time else {}
        return found | {"log_return": log_return(F.lag("close").over(w)), "label": F.lead("close").over(w)} | at

    rows = with_indicators(bars.select("symbol", "timestamp", "close"), interval, step, before=max(lags, 1), after=1).withColumn("hour", F.hour("timestamp"))
    return rows.select("symbol", "timestamp", "close", "log_return", *lagged, "hour", "label", *(["label_at"] if label_time else []), *INDICATOR_COLUMNS)


def inputs(lags: int = 3) -> list[str]:
    return ["close", *[f"close_lag_{i}" for i in range(1, lags + 1)], "hour", *INDICATOR_COLUMNS]


def split(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows, cut at a share of the time span."""
    a, b = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    at = F.lit(a + (b - a) * share).cast("timestamp_ntz")
    return rows.filter(F.col("timestamp") <= at), rows.filter(F.col("timestamp") > at)


def fit(rows: DataFrame, kind: str = "linear", lags: int = 3, seed: int = 7) -> PipelineModel:
    """A linear or boosted-tree model of the next close."""
    learner = LinearRegression(labelCol="label", regParam=0.01) if kind == "linear" else GBTRegressor(labelCol="label", maxIter=20, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs(lags), outputCol="features", handleInvalid="skip"), learner]).fit(rows.filter("label is not null"))


def save(model: PipelineModel, path: str) -> None:
    """Keep a fitted model; a repeated call replaces it."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame, name: str, interval: str = "1h") -> DataFrame:
    step = F.expr(f"INTERVAL {INTERVALS[interval]}")
    out = model.transform(rows)
    return out.select("symbol", (F.col("timestamp") + step).alias("predicted_at"), (F.col("timestamp") + step).alias("target_time"), "prediction", F.lit(name).alias("model"), "label")


def naive(bars: DataFrame, interval: str = "1h") -> DataFrame:
    """The baseline: the next close is the last one."""
    step = F.expr(f"INTERVAL {INTERVALS[interval]}")
    at, label = F.col("timestamp") + step, F.col("label")
    known = windowed(numbered(bars, block(interval)), lambda w: {"label": F.lead("close").over(w)}, after=1)
    return known.select("symbol", at.alias("predicted_at"), at.alias("target_time"), F.col("close").alias("prediction"), F.lit("naive").alias("model"), label)


def evaluate(predictions: DataFrame) -> DataFrame:
    off = F.col("prediction") - F.col("label")
    known = predictions.filter("label is not null")
    return known.groupBy("symbol", "model").agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), F.avg(F.abs(off / F.nullif(F.col("label"), F.lit(0.0)))).alias("mape"), F.count(F.lit(1)).alias("n"))
