"""Targets that rates can and can't meet against the conditions of the optimum, and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

DATA = "/root/testdata/sf0.001"
NAMES = list(mixing.DOMAINS)


@pytest.fixture(scope="module")
def chances(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([6, 3, 1, 0.5], 400)
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(rng.integers(0, 900, 400), p)]
    return spark.createDataFrame(rows, "_tokens bigint, _chances array<double>").repartition(3).cache()


@pytest.mark.parametrize("targets, met", [
    ({"good": 0.6, "poor": 0.3, "good_toxic": 0.06, "poor_toxic": 0.04}, True),
    ({"good": 0.001, "poor_toxic": 0.999}, False),
    ({"poor": 0.5, "good_toxic": 0.5}, False),
    ({"good": 1.0}, False),
])
@pytest.mark.filterwarnings("ignore:targets")
def test_rates_and_the_nearest_that_can_be_reached(chances, targets, met):
    steps = mixing.fit_rates(chances, NAMES, targets)
    rows = chances.collect()
    p, tokens = np.array([r._chances for r in rows]), np.array([r._tokens for r in rows])
    a = p * tokens[:, None]
    rate = mixing.rates(a, steps)
    by_spark = sorted(r._rate for r in mixing.with_rates(chances, steps).collect())
    assert np.allclose(by_spark, np.sort(rate), rtol=1e-9, atol=1e-9)
    total, share = tokens.sum(), np.array([targets.get(n, 0.0) for n in NAMES])
    got, want = a.T @ rate, total * share / share.sum()
    missing = want - got
    if met:
        assert np.abs(missing).max() <= 1e-6 * total and steps.short == 0.0
        return
    best = mixing.nearest(chances, want)
    missing = want - best
    # no document points towards what is missing, and what is there is at right angles to it: no nearer point exists
    assert np.linalg.norm(missing) > 0.01 * total and abs(steps.short - np.abs(missing).max() / total) < 1e-6
    assert (p[tokens > 0] @ missing).max() <= 1e-8 * np.linalg.norm(missing)
    assert abs(best @ missing) <= 1e-8 * np.linalg.norm(best) * np.linalg.norm(missing)
    # the descent came nearer, and says how much is left
    assert abs(steps.residual - np.abs(best - got).max() / total) < 1e-6
    assert np.abs(best - got).max() < np.abs(best - a.sum(0)).max()


def test_active_sets_meet_the_conditions_of_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, t = rng.normal(size=(4, rng.integers(1, 12))), rng.normal(size=4)
        x = mixing.nonnegative(g, t)
        slope = g.T @ (t - g @ x)
        assert (x >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[x > 0]).max(initial=0) <= 1e-8


def test_columns_with_the_names_that_mixing_uses(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = docs.select("doc_id", "text").withColumns({"_u": F.lit("mine"), "_x": F.lit(3), "row": F.lit(1.5), "_rate": F.lit("old"), "u": F.lit(None).cast("int"), "x": F.lit("y")})
    out, _ = mixing.mix(odd, labels)
    r = out.first()
    assert (r._u, r._x, r.row, r.u, r.x) == ("mine", 3, 1.5, None, "y") and isinstance(r._rate, float)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_u", "_x", "row", "u", "x", *mixing.ADDED])
    plain, _ = mixing.mix(docs.select("doc_id", "text"), labels)
    assert sorted((x.doc_id, x._copies) for x in out.collect()) == sorted((x.doc_id, x._copies) for x in plain.collect())
    back = mixing.mixed(odd, labels)
    assert back.columns == odd.columns and {r._rate for r in back.select("_rate").collect()} == {"old"}
