"""Drift of numeric columns between a reference and a current sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = 1e-4
#: values are counted in so many ranges of each column
RANGES = 256


def _choose(cols: list[str], value) -> F.Column:
    """value(c) for rows of column c."""
    return reduce(lambda e, c: F.when(F.col("column") == c, value(c)).otherwise(e), cols, F.lit(None).cast("int"))


def _above(marks: list[float], step: int = 16) -> F.Column:
    """How many of the sorted marks lie below x, sought in two steps where they are many."""
    count = lambda of: F.size(F.filter(of, lambda v: v < F.col("x")))
    array = lambda of: F.split(F.lit(",".join(map(repr, of))), ",").cast("array<double>") if of else F.array().cast("array<double>")
    if len(marks) <= step:
        return count(array(marks))
    part = count(array(marks[step - 1 :: step]))  # one literal each, which keeps the plan small
    return part * step + count(F.slice(array(marks), part * step + 1, F.lit(step)))


def _flat(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """column, x, r, c: each value that is there, of both samples; r and c tell from which."""
    both = ref.select(*cols, F.lit(1).alias("r"), F.lit(0).alias("c")).union(cur.select(*cols, F.lit(0), F.lit(1)))
    return both.select("r", "c", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))).filter("x is not null")


def _running(flat: DataFrame, cols: list[str]) -> DataFrame:
    """column, x, r and c up to x, nr and nc in all: for every distinct value.

    The running counts are made in ranges between approximate quantiles of a column and carried over the ranges'
    totals, so no task sorts all rows, wherever the values lie.
    """
    points = flat.groupBy("column", "x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = {b.column: sorted(set(b.q)) for b in points.groupBy("column").agg(F.percentile_approx("x", shares, 10 * RANGES).alias("q")).collect()}  # a row a column
    points = points.withColumn("_b", _choose(cols, lambda c: _above(bounds.get(c, []))))
    totals = points.groupBy("column", "_b").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))  # at most RANGES rows a column
    run = W.partitionBy("column").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("column")
    carry = totals.select("column", "_b", F.coalesce(F.sum("tr").over(run), F.lit(0)).alias("br"), F.coalesce(F.sum("tc").over(run), F.lit(0)).alias("bc"), F.sum("tr").over(every).alias("nr"), F.sum("tc").over(every).alias("nc"))
    own = W.partitionBy("column", "_b").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return points.join(carry, ["column", "_b"]).select("column", "x", (F.col("br") + F.sum("r").over(own)).alias("r"), (F.col("bc") + F.sum("c").over(own)).alias("c"), "nr", "nc")


def _distance() -> F.Column:
    part = lambda n, of: F.col(n) / F.nullif(F.col(of), F.lit(0))
    return F.max(F.abs(part("r", "nr") - part("c", "nc"))).alias("ks")


def _measured(running: DataFrame, bins: int) -> tuple[dict[str, list[float]], dict[str, float]]:
    """Edges and KS distance of each column. The edges are exact quantiles, interpolated between the values at the ranks on both sides."""
    ranks = [(F.col("nr") - 1) * i / bins for i in range(1, bins)]
    ends = [F.struct(*[F.min(F.when(F.col("r") > side(rank), F.col("x"))).alias(name) for name, side in (("lo", F.floor), ("hi", F.ceil))], F.max(rank - F.floor(rank)).alias("f")) for rank in ranks]
    found = running.groupBy("column").agg(_distance(), F.max("nr").alias("n"), *[e.alias(f"e{i}") for i, e in enumerate(ends)]).collect()  # a row a column
    edges = {row.column: [e.lo if e.lo == e.hi else e.lo + (e.hi - e.lo) * e.f for e in row[3:]] for row in found if row.n}
    return edges, {row.column: row.ks for row in found}


def _psi(flat: DataFrame, edges: dict[str, list[float]], cols: list[str]) -> DataFrame:
    binned = flat.withColumn("bin", _choose(cols, lambda c: _above(edges.get(c, []))))
    pivot = binned.groupBy("column", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    per = W.partitionBy("column")  # at most `bins` rows for a column
    r = F.greatest(F.coalesce(F.col("r") / F.nullif(F.sum("r").over(per), F.lit(0)), F.lit(0.0)), F.lit(FLOOR))
    c = F.greatest(F.coalesce(F.col("c") / F.nullif(F.sum("c").over(per), F.lit(0)), F.lit(0.0)), F.lit(FLOOR))
    return pivot.select("column", ((c - r) * F.log(c / r)).alias("x")).groupBy("column").agg(F.sum("x").alias("psi"))


def psi(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Population stability index on the reference's deciles; empty bins count as FLOOR. No row for a column without values."""
    flat = _flat(ref, cur, cols)
    return _psi(flat, _measured(_running(flat, cols), bins)[0], cols)


def ks(ref: DataFrame, cur: DataFrame, col: str, grid: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of a column; no row where neither sample has a value.

    With a grid, values are first mapped to so many approximate quantiles of the reference, within 1 / grid of the
    exact distance.
    """
    flat = _flat(ref, cur, [col])
    if grid:
        marks = sorted(set(ref.agg(F.percentile_approx(F.col(col).cast("double"), [i / grid for i in range(grid + 1)], 100 * grid)).first()[0] or []))
        flat = flat.withColumn("x", _above(marks).cast("double"))
    return _running(flat, [col]).groupBy("column").agg(_distance())


def drift_report(ref: DataFrame, cur: DataFrame, cols: list[str], psi_from: float = 0.2, ks_from: float = 0.1) -> DataFrame:
    """column, statistic, value, threshold, drifted: all columns in the same passes."""
    flat = _flat(ref, cur, cols)
    edges, distance = _measured(_running(flat, cols), 10)
    a = _psi(flat, edges, cols).select("column", F.lit("psi").alias("statistic"), F.col("psi").alias("value"), F.lit(psi_from).alias("threshold"))
    b = ref.sparkSession.createDataFrame(list(distance.items()), "column string, value double").select("column", F.lit("ks").alias("statistic"), "value", F.lit(ks_from).alias("threshold"))
    return a.unionByName(b).withColumn("drifted", F.col("value") >= F.col("threshold"))
