"""Walk-forward forecasts against least squares fitted by numpy on what lies before each cut."""

import datetime as dt
import math
import random

import numpy as np

from rillstone.operators import analysis

CUTS = ["2020-02-01", "2020-03-01", "2020-05-01"]


def made():
    rng, rows = random.Random(9), []
    for g in ("a", "b", None, "short", "flat"):
        for k in range(6 if g == "short" else 150):
            x = [rng.gauss(1e6 if g == "b" else 0, 1), 3.0 if g == "flat" else rng.random(), rng.uniform(-5, 5)]
            y = 2 * x[0] - 30 * x[1] + 0.5 * x[2] + rng.gauss(0, 1)
            rows.append((g, dt.date(2020, 1, 1) + dt.timedelta(k if g != "short" else k * 20), *(None if rng.random() < 0.02 else v for v in x), None if rng.random() < 0.02 else y, rng.random()))
    return rows


def test_against_numpy(spark):
    rows = made()
    df = spark.createDataFrame(rows, "g string, date date, x double, z double, w double, y double, previous double").repartition(3)
    got = {(r.g, r.date): r for r in analysis.walk_forward(df, ["g"], "date", ["x", "z", "w"], "y", CUTS).collect()}
    cuts = [dt.date.fromisoformat(c) for c in CUTS]
    whole = [r for r in rows if None not in r[2:6]]
    assert set(got) == {(r[0], r[1]) for r in whole if r[1] >= cuts[0]}
    for g, date, *x, y, _ in whole:
        if date < cuts[0]:
            continue
        fold = sum(date >= c for c in cuts)
        train = [r for r in whole if r[0] == g and r[1] < cuts[fold - 1]]
        r = got[g, date]
        assert (r.fold, r.target, r.n_train) == (fold, y, len(train))
        if len(train) < 5 or g == "flat":  # too few rows, or a predictor that never changes
            assert r.forecast is None
        else:
            beta = np.linalg.lstsq(np.array([[1, *t[2:5]] for t in train]), np.array([t[5] for t in train]), rcond=None)[0]
            assert math.isclose(r.forecast, beta @ [1, *x], rel_tol=1e-6, abs_tol=1e-6)


def test_errors_beside_persistence(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 4.0), ("a", 3.0, 3.0, 1.0), ("a", None, 3.0, 1.0), ("a", 1.0, 3.0, None), ("b", 2.0, 2.0, 2.0)], "g string, forecast double, target double, previous double")
    got = {r.g: r for r in analysis.forecast_errors(df, ["g"]).collect()}
    assert (got["a"].n, got["a"].mae, got["a"].mae_persistence) == (2, 0.5, 2.0) and math.isclose(got["a"].skill, 1 - 0.5 / 4)
    assert got["b"].n == 1 and got["b"].rmse == 0 and got["b"].skill is None


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame(made(), "g string, date date, x double, z double, w double, y double, previous double")
    whole = analysis.walk_forward(df, [], "date", ["x"], "y", CUTS)
    assert whole.columns == ["date", "fold", "target", "forecast", "n_train"] and whole.filter("forecast is null").count() == 0
    assert analysis.walk_forward(df.limit(0), ["g"], "date", ["x"], "y", CUTS).count() == 0
