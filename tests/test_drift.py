"""KS against a direct count, where one value lies far from all others, and with ties."""

import numpy as np
import pytest

from tidemark.operators import drift


@pytest.mark.parametrize("far", [0.0, 1e12])
def test_ks_with_an_outlier_and_ties(spark, far):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=900), 1), np.append(np.round(rng.normal(0.4, 1.2, 700), 2), far)
    frame = lambda x: spark.createDataFrame([(v,) for v in x.tolist()] + [(None,)], "x double")
    points = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert abs(drift.ks(frame(a), frame(b), "x").first().ks - want) < 1e-12


def test_psi_of_equal_samples_and_of_an_empty_bin(spark):
    a = spark.range(1000).selectExpr("cast(id as double) x", "if(id < 900, null, 1.0) y")
    assert {r.statistic: r.value for r in drift.drift_report(a, a, ["x"]).collect()} == {"psi": 0.0, "ks": 0.0}
    low = a.filter("x < 100")
    found = {(r.column, r.statistic): r.value for r in drift.drift_report(a, low, ["x", "y"]).collect()}
    floor, share = drift.FLOOR, 0.1
    assert abs(found["x", "psi"] - ((1 - share) * np.log(1 / share) + 9 * (floor - share) * np.log(floor / share))) < 1e-9
    assert abs(found["x", "ks"] - 0.9) < 1e-12 and found["y", "ks"] is None  # y has no value below 900


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_edges_are_exact_quantiles(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 2)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x double")
    flat = drift._flat(df, df, ["x"])
    edges, _ = drift._measured(drift._running(flat, ["x"]), 10)
    assert np.allclose(edges["x"], np.quantile(x, [i / 10 for i in range(1, 10)]), rtol=0, atol=1e-12)
