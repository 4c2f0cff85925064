"""Drift from daily sketches against the exact drift, for several pairs of periods and odd columns."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import drift, sketches
from tidemark.sources import writers

START = dt.date(2024, 1, 1)
DAYS = 12


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(6), []
    for day in range(DAYS):
        for i in range(1500):
            x = float(rng.normal(day * 0.15, 1 + 0.02 * day))
            y = float(rng.integers(0, 5))
            out.append((dt.datetime(2024, 1, 1 + day, i % 24), None if i % 50 == 0 else x, y, None, float("nan") if i % 2 else x))
    return spark.createDataFrame(out, "timestamp timestamp_ntz, x double, y double, never double, half double").repartition(7).cache()


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches"))
    made = sketches.daily_sketches(rows, ["x", "y", "never", "half"])
    for _ in range(2):  # merged by day and column, so a repeat changes nothing
        writers.upsert(made, path, ["date", "column"], time="date")
    return spark.read.parquet(path)


def day(n):
    return START + dt.timedelta(days=n)


def of(rows, a, b):
    return rows.filter((rows.timestamp >= dt.datetime.combine(day(a), dt.time())) & (rows.timestamp < dt.datetime.combine(day(b), dt.time())))


def test_a_sketch_for_each_day_and_column_that_has_values(stored):
    got = stored.collect()
    assert len(got) == 3 * DAYS and {r.column for r in got} == {"x", "y", "half"}


@pytest.mark.parametrize("ref, cur", [((0, 6), (6, 12)), ((0, 1), (11, 12)), ((3, 7), (2, 9))])
def test_any_two_periods_within_the_stated_error(rows, stored, ref, cur):
    got = {(r.column, r.statistic): r for r in sketches.drift_between(*[sketches.period(stored, day(a), day(b)) for a, b in (ref, cur)]).collect()}
    exact = {(r.column, r.statistic): r for r in drift.drift_report(of(rows, *ref), of(rows, *cur), ["x", "y"]).collect()}
    error = sketches.rank_error()
    for c in ("x", "y"):
        assert abs(got[c, "ks"].value - exact[c, "ks"].value) <= 2 * error + 1 / sketches.POINTS
        assert got[c, "ks"].drifted == exact[c, "ks"].drifted
    assert abs(got["x", "psi"].value - exact["x", "psi"].value) <= 0.02 + 0.1 * exact["x", "psi"].value
    assert got["x", "psi"].drifted == exact["x", "psi"].drifted


def test_small_sketches_keep_their_larger_error(rows):
    k = 200
    made = sketches.daily_sketches(rows, ["x"], k=k)
    got = {r.statistic: r.value for r in sketches.drift_between(sketches.period(made, day(0), day(6)), sketches.period(made, day(6), day(12))).collect()}
    exact = drift.ks(of(rows, 0, 6), of(rows, 6, 12), "x").first().ks
    assert abs(got["ks"] - exact) <= 2 * sketches.rank_error(k) + 1 / sketches.POINTS
    assert 0.013 < sketches.rank_error(200) < 0.0135


def test_equal_and_empty_periods(stored):
    a = sketches.period(stored, day(0), day(4))
    got = sketches.drift_between(a, a).collect()  # two merges of the same sketches differ by chance, within the error
    assert len(got) == 6 and not any(r.drifted for r in got)
    assert all(r.value <= (2 * sketches.rank_error() if r.statistic == "ks" else 0.01) for r in got)
    assert sketches.drift_between(a, sketches.period(stored, day(40), day(50))).collect() == []
