"""Models fitted day by day against a solver on the rows themselves; saved models; the boosted trees on a known function."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import forecast
from tidemark.operators import walk_forward as wf

START = dt.datetime(2024, 1, 1)
INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(7), []
    for symbol, days in (("A", 9), ("B", 5), ("C", 1)):
        for h in range(24 * days):
            a, b = 1000 + rng.normal(), rng.normal() * 0.01
            label = None if h == 24 * days - 1 else 3 + 2 * a - 40 * b + rng.normal()
            out.append((symbol, START + dt.timedelta(hours=h), float(a), None if h % 17 == 3 else float(b), 5.0, label, START + dt.timedelta(hours=h + 2)))
    return spark.createDataFrame(out, "symbol string, timestamp timestamp_ntz, a double, b double, c double, label double, label_at timestamp_ntz").repartition(5).cache()


def test_each_model_equals_a_fit_on_the_rows_known_before_its_day(rows):
    days = rows.selectExpr("symbol", "to_date(timestamp) as day").distinct()
    got = {(r.symbol, r.day): r for r in wf.models(wf.moments(rows, INPUTS), days, 3).collect()}
    all_rows = rows.collect()
    for r in days.collect():
        known = [x for x in all_rows if x.symbol == r.symbol and x.label is not None and x.b is not None and x.label_at.date() < r.day]
        if len(known) < 5:
            assert (r.symbol, r.day) not in got
            continue
        x, y = np.array([[k.a, k.b, k.c] for k in known]), np.array([k.label for k in known])
        w = np.linalg.lstsq(np.c_[x - x.mean(0)], y - y.mean(), rcond=1e-10)[0]
        m = got[r.symbol, r.day]
        assert m.n == len(known) and np.allclose(m.weights, w, rtol=1e-6, atol=1e-6)
        assert m.weights[2] == 0.0 and abs(m.intercept - (y.mean() - w @ x.mean(0))) < 1e-3


def test_no_model_sees_a_later_row(spark, rows):
    """Changing all that is not known before a day changes no prediction of the day."""
    day = dt.date(2024, 1, 5)
    changed = rows.selectExpr("symbol", "timestamp", "a", "b", "c", "if(to_date(label_at) >= date'2024-01-05', label * 7 + 1, label) as label", "label_at")
    of = lambda df: sorted((r.symbol, r.predicted_at, r.prediction) for r in wf.walk_forward(df, INPUTS).collect() if (r.predicted_at - dt.timedelta(hours=1)).date() == day)
    assert of(rows) == of(changed) and len(of(rows)) > 40
    assert [r.prediction for r in wf.walk_forward(rows, INPUTS).filter("to_date(predicted_at) > date'2024-01-07'").limit(5).collect()] != [r.prediction for r in wf.walk_forward(changed, INPUTS).filter("to_date(predicted_at) > date'2024-01-07'").limit(5).collect()]


def test_predictions_are_near_and_rows_without_a_model_have_none(rows):
    got = wf.walk_forward(rows, INPUTS)
    assert {r.symbol for r in got.collect()} == {"A", "B"} and got.filter("predicted_at <= timestamp'2024-01-02 00:00:00'").isEmpty()
    scored = {r.symbol: r for r in forecast.evaluate(got).collect()}
    assert scored["A"].rmse < 1.5 and scored["B"].rmse < 2


def test_empty_table(spark, rows):
    assert wf.walk_forward(rows.limit(0), INPUTS).collect() == []


def features(spark, n=240):
    rng, names = np.random.default_rng(5), forecast.inputs()
    x = rng.uniform(0, 1, (n, len(names)))
    y = np.where(x[:, 0] > 0.5, 10.0, 2.0) + np.where(x[:, 3] > 0.3, 4.0, 0.0)
    data = [("A", START + dt.timedelta(hours=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "symbol string, timestamp timestamp_ntz, " + ", ".join(f"`{c}` double" for c in names) + ", label double"), y


def test_boosted_trees_learn_steps_that_a_line_cannot(spark):
    df, y = features(spark)
    trees = [r.prediction for r in forecast.predict(forecast.fit(df, "trees"), df, "trees").orderBy("predicted_at").collect()]
    line = [r.prediction for r in forecast.predict(forecast.fit(df, "linear"), df, "linear").orderBy("predicted_at").collect()]
    assert np.sqrt(np.mean((trees - y) ** 2)) < 0.05 < 1 < np.sqrt(np.mean((line - y) ** 2))
    again = [r.prediction for r in forecast.predict(forecast.fit(df, "trees"), df, "trees").orderBy("predicted_at").collect()]
    assert again == trees


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_a_saved_model_predicts_as_before(spark, tmp_path, kind):
    df, _ = features(spark, 80)
    model, path = forecast.fit(df, kind), str(tmp_path / "m")
    for _ in range(2):
        forecast.save(model, path)
    of = lambda m: [r.prediction for r in forecast.predict(m, df, kind).orderBy("predicted_at").collect()]
    assert of(forecast.load(path)) == of(model)
