"""Drift between any two periods from quantile sketches of each day, without another scan of the rows.

A day and column has a KLL sketch; the sketches of a period merge into one of the same size. Shares of values up to a
point are then right within the sketch's rank error.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.drift import FLOOR

#: size of the sketches
K = 2_048
#: the distance is sought at so many quantiles of each period
POINTS = 512


def rank_error(k: int = K) -> float:
    """The error of a share of values that 99 of 100 sketches of size k keep, by the published formula of KLL sketches."""
    return 2.296 / k**0.9723


def daily_sketches(df: DataFrame, cols: list[str], time: str = "timestamp", k: int = K) -> DataFrame:
    """date, column, sketch for each day; null and NaN values are left out. One pass, with partial sketches in each task."""
    days = df.groupBy(F.to_date(time).alias("date")).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"_{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(cols)])
    return days.select("date", F.inline(each)).filter(F.kll_sketch_get_n_double("sketch") > 0)


def period(sketches: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """column, sketch of the days from start to before end."""
    first, last = (F.lit(d.isoformat()).cast("date") for d in (start, end))
    days = sketches.filter((F.col("date") >= first) & (F.col("date") < last))
    return days.groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _ranks(sketch: str, points: dict[str, list[float]]) -> Column:
    """The shares of values up to each of the column's points, which the function wants as constants."""
    fixed = lambda of: F.split(F.lit(",".join(map(repr, of))), ",").cast("array<double>")
    found = [F.when(F.col("column") == c, F.kll_sketch_get_rank_double(sketch, fixed(of))) for c, of in points.items()]
    return F.coalesce(*found) if found else F.array().cast("array<double>")


def _between(ranks: Column) -> Column:
    """The shares of values up to the first point, between two points, and above the last."""
    ends = F.concat(ranks, F.array(F.lit(1.0)))
    return F.zip_with(ends, F.concat(F.array(F.lit(0.0)), ranks), lambda b, a: b - a)


def drift_between(ref: DataFrame, cur: DataFrame, bins: int = 10, psi_from: float = 0.2, ks_from: float = 0.1) -> DataFrame:
    """column, statistic, value, threshold, drifted of two periods, a row for each statistic of a column that both have.

    The stability index compares shares between the reference's quantiles, of which each is off by twice the rank error
    at most. The KS distance is off by the rank errors of both sketches, and by 1 / POINTS, because it is sought at the
    quantiles of both only.
    """
    both = ref.select("column", F.col("sketch").alias("r")).join(cur.select("column", F.col("sketch").alias("c")), "column")
    at = lambda sketch, n: F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / n) for i in range(1, n)]))
    found = both.select("column", at("r", bins).alias("edges"), F.concat(at("r", POINTS), at("c", POINTS)).alias("points")).collect()  # a row a column
    edges, points = {f.column: f.edges for f in found}, {f.column: f.points for f in found}
    floor = lambda x: F.greatest(x, F.lit(FLOOR))
    parts = F.zip_with(_between(_ranks("r", edges)), _between(_ranks("c", edges)), lambda r, c: (floor(c) - floor(r)) * F.log(floor(c) / floor(r)))
    psi = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    ks = F.array_max(F.zip_with(_ranks("r", points), _ranks("c", points), lambda r, c: F.abs(r - c)))
    rows = F.array(F.struct(F.lit("psi").alias("statistic"), psi.alias("value"), F.lit(psi_from).alias("threshold")), F.struct(F.lit("ks").alias("statistic"), ks.alias("value"), F.lit(ks_from).alias("threshold")))
    return both.select("column", F.inline(rows)).withColumn("drifted", F.col("value") >= F.col("threshold"))
