"""The linear model against ridge regression in closed form, and its predictions' times."""

import datetime as dt

import numpy as np

from tidemark.operators import forecast


def test_linear_model_equals_closed_form(spark):
    rng, names, start = np.random.default_rng(4), forecast.inputs(), dt.datetime(2024, 1, 1)
    x = rng.normal(size=(120, len(names))) * rng.uniform(0.5, 20, len(names)) + rng.normal(size=len(names))
    y = x @ rng.normal(size=len(names)) + rng.normal(size=120) + 30
    rows = [("A", start + dt.timedelta(hours=i), *map(float, x[i]), None if i >= 100 else float(y[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names) + ", label double")
    got = forecast.predict(forecast.fit(df), df, "linear").orderBy("predicted_at").collect()

    known, target = x[:100], y[:100]
    mean, std, spread = known.mean(0), known.std(0), target.std()
    z = (known - mean) / std
    w = np.linalg.solve(z.T @ z / 100 + 0.01 / spread * np.eye(len(names)), z.T @ (target - target.mean()) / spread / 100)
    want = (x - mean) / std @ w * spread + target.mean()
    assert np.allclose([r.prediction for r in got], want, rtol=0, atol=1e-6)
    assert [r.predicted_at for r in got] == [r.target_time for r in got] == [start + dt.timedelta(hours=i + 1) for i in range(120)]

    scored = forecast.evaluate(forecast.predict(forecast.fit(df), df, "linear")).collect()
    off = want[:100] - target
    assert len(scored) == 1 and scored[0].n == 100
    assert np.allclose([scored[0].rmse, scored[0].mae, scored[0].mape], [np.sqrt((off**2).mean()), np.abs(off).mean(), np.abs(off / target).mean()])
