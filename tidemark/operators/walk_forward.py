"""Linear price models fitted day by day on what was known before the day, from sums of products.

A symbol and day has the sums of products of all pairs of 1, the inputs and the label. Their running sums up to a day are
all that the least-squares fit before it needs, so no row is read twice and no model sees a later one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schemas import INTERVALS

#: singular values below this share of the largest count as none
LEAST = 1e-10
MODEL = "symbol string, day date, n bigint, intercept double, weights array<double>"


def moments(rows: DataFrame, inputs: Sequence[str], label: str = "label", known_at: str = "label_at") -> DataFrame:
    """symbol, day, i, j, sum: sums of products of the terms i <= j of (1, *inputs, label), by the day their label was known.

    Rows in which an input, the label or its time is null are left out. One row a symbol, day and pair; the sums are made
    in each task first. Inputs are counted from the first of each symbol's day on as they are; the fit centres them.
    """
    terms = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in (*inputs, label)]]
    known = rows.dropna(subset=[*inputs, label, known_at])
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = known.groupBy("symbol", F.to_date(known_at).alias("day")).agg(*[F.sum(terms[i] * terms[j]).alias(f"_{i}_{j}") for i, j in pairs])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("sum")) for i, j in pairs])
    return sums.select("symbol", "day", F.inline(each))


def _solved(size: int, least: float):
    """Batches of symbol, day, pairs -> models. Means are taken off before the normal equations are solved."""

    def solve(batches):
        for b in batches:
            out = []
            for symbol, day, pairs in zip(*(c.to_pylist() for c in b.columns)):
                m = np.zeros((size + 2, size + 2))
                for p in pairs:
                    m[p["i"], p["j"]] = m[p["j"], p["i"]] = p["sum"]
                n = m[0, 0]
                mean = m[0, 1:] / n
                centred = m[1:, 1:] - n * np.outer(mean, mean)
                scale = np.sqrt(np.maximum(centred.diagonal()[:size], 0))
                scale = np.where(scale > least * np.sqrt(n) * np.maximum(np.abs(mean[:size]), 1e-300), scale, np.inf)  # an input that does not vary has no weight
                a = centred[:size, :size] / np.outer(scale, scale)
                w = np.linalg.lstsq(a, centred[:size, size] / scale, rcond=least)[0] / scale
                out.append((symbol, day, int(n), float(mean[size] - w @ mean[:size]), w.tolist()))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.date32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.list_(pa.float64()))], ["symbol", "day", "n", "intercept", "weights"])

    return solve


def models(sums: DataFrame, days: DataFrame, size: int, least_rows: int | None = None, least: float = LEAST) -> DataFrame:
    """A model for each symbol and day of `days`, fitted on the labels that were known before that day.

    Days before which a symbol has fewer than least_rows (inputs + 2 unless given) labels have none. Inputs that depend on
    each other get the weights of least norm.
    """
    pairs = sums.select("symbol", "i", "j").distinct()
    asked = days.select("symbol", "day").distinct()
    every = sums.select("symbol", "day", "i", "j", "sum", F.lit(False).alias("asked")).unionByName(asked.join(pairs, "symbol").select("symbol", "day", "i", "j", F.lit(0.0).alias("sum"), F.lit(True).alias("asked")))
    before = W.partitionBy("symbol", "i", "j").orderBy("day", F.desc("asked")).rowsBetween(W.unboundedPreceding, -1)  # a row a day
    running = every.withColumn("sum", F.sum("sum").over(before)).filter("asked and sum is not null")
    folds = running.groupBy("symbol", "day").agg(F.collect_list(F.struct("i", "j", "sum")).alias("pairs"))  # one entry a pair
    known = folds.filter(F.exists("pairs", lambda p: (p["i"] == 0) & (p["j"] == 0) & (p["sum"] >= (size + 2 if least_rows is None else least_rows))))
    return known.select("symbol", "day", "pairs").mapInArrow(_solved(size, least), MODEL)


def predicted(rows: DataFrame, fitted: DataFrame, inputs: Sequence[str], interval: str = "1h", name: str = "walk_forward", day: str | None = None) -> DataFrame:
    """Predictions of the rows of each model's day, or of all rows by the models of the day `day` names; rows without one have none."""
    step = F.expr(f"INTERVAL {INTERVALS[interval]}")
    at = F.col("timestamp") + step
    key = F.to_date("timestamp") if day is None else F.lit(day).cast("date")
    joined = rows.withColumn("day", key).join(fitted.select("symbol", "day", "intercept", "weights"), ["symbol", "day"])
    value = F.col("intercept")
    for i, c in enumerate(inputs):
        value = value + F.col("weights")[i] * F.col(f"`{c}`")
    return joined.select("symbol", at.alias("predicted_at"), at.alias("target_time"), value.alias("prediction"), F.lit(name).alias("model"), *[c for c in ("label",) if c in rows.columns]).filter("prediction is not null")


def walk_forward(rows: DataFrame, inputs: Sequence[str], interval: str = "1h", least_rows: int | None = None) -> DataFrame:
    """Predictions of all rows of features(..., label_time=True), each by the model of its day."""
    days = rows.select("symbol", F.to_date("timestamp").alias("day")).distinct()
    return predicted(rows, models(moments(rows, inputs), days, len(inputs), least_rows), inputs, interval)
