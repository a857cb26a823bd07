"""The spline from moments against a dense fit; the competition's gates."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import smooth


def dense_basis(u, k):
    """Natural cubic basis by interpolating unit vectors at the knots, row by row."""
    h = 1 / (k - 1)
    system, out = np.eye(k), np.zeros((len(u), k))
    for j in range(k):
        values = system[j]
        a, rhs = np.eye(k), np.zeros(k)
        for i in range(1, k - 1):
            a[i, i - 1 : i + 2] = h / 6, 2 * h / 3, h / 6
            rhs[i] = (values[i + 1] - 2 * values[i] + values[i - 1]) / h
        bend = np.linalg.solve(a, rhs)
        for r, x in enumerate(u):
            c = min(k - 2, int(x / h))
            lo, hi = c * h, (c + 1) * h
            out[r, j] = (values[c] * (hi - x) + values[c + 1] * (x - lo)) / h + ((hi - x) ** 3 / h - h * (hi - x)) / 6 * bend[c] + ((x - lo) ** 3 / h - h * (x - lo)) / 6 * bend[c + 1]
    return out


@pytest.mark.parametrize("k", [4, 7, 10])
def test_moments_give_the_dense_fit(spark, k):
    rng = np.random.default_rng(k)
    u = np.r_[0.0, 1.0, rng.random(300)]
    y = np.sin(5 * u) + rng.normal(0, 0.2, len(u))
    m = smooth.moments(spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, y)], "u double, y double"), "u", "y", k)
    fit = smooth.fit_spline(m)
    x = dense_basis(u, k)
    _, s = smooth._second_derivatives(k)
    want = np.linalg.solve(x.T @ x + fit.penalty * s, x.T @ y)
    assert np.allclose(fit.values, want, atol=1e-8)
    assert math.isclose(fit.degrees, np.trace(np.linalg.solve(x.T @ x + fit.penalty * s, x.T @ x)), abs_tol=1e-8)
    # no other penalty has a better score, and the penalty is the integral of the squared second derivative
    scores = []
    for p in smooth.PENALTIES * len(u):
        hat = x @ np.linalg.solve(x.T @ x + p * s, x.T)
        scores.append(len(u) * np.sum((y - hat @ y) ** 2) / (len(u) - np.trace(hat)) ** 2)
    assert math.isclose(fit.score, min(scores), rel_tol=1e-6)
    grid = np.linspace(0, 1, 20_001)
    bend = np.diff(dense_basis(grid, k) @ want, 2) / (grid[1] - grid[0]) ** 2
    assert math.isclose(want @ s @ want, np.mean(bend**2), rel_tol=2e-2)


def test_curve_inside_and_outside(spark):
    k = 6
    fit = smooth.Spline(np.array([0.0, 1.0, 0.0, 2.0, -1.0, 0.5]), 1.0, 3.0, 0.0)
    u = [0.0, 0.13, 0.5, 0.999, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*u, -0.5, 2.0, 3.0]], "u double").select(fit.predict(F.col("u"))).collect()]
    assert np.allclose(got[:5], dense_basis(np.array(u), k) @ fit.values, atol=1e-10)
    slope = np.diff(dense_basis(np.array([1 - 1e-6, 1.0]), k) @ fit.values)[0] / 1e-6
    assert math.isclose(got[6] - fit.values[-1], slope, rel_tol=1e-4) and math.isclose(got[7] - got[6], got[6] - fit.values[-1], rel_tol=1e-9)


def days(n, value):
    return [(str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i)), value(i)) for i in range(n)]


def test_competition(spark):
    rng = random.Random(0)
    run = lambda rows: smooth.trend_competition(spark.createDataFrame(rows, "t string, v string"), "t", "v").first()
    line = run([*days(60, lambda i: f"{3 * i + rng.random()}"), ("2024-13-01", "1"), ("2024-02-01x", None)])
    assert (line.status, line.observed_rows, line.dropped_rows, line.training_rows, line.holdout_rows) == ("succeeded", 60, 2, 48, 12)
    assert math.isclose(line.slope, 3, abs_tol=0.05) and line.linear_mae < 1 and line.smooth_mae < 2 and line.degrees < 3
    wave = run(days(100, lambda i: str(abs(i - 50) ** 1.5)))
    assert wave.smooth_mae < wave.linear_mae and wave.mean_difference < 0 and wave.degrees > 3
    assert math.isclose(wave.mean_difference, wave.smooth_mae - wave.linear_mae, abs_tol=1e-9)
    reasons = {"too few complete rows": days(14, str), "several rows of one time": days(20, str) + days(1, str), "the value hardly varies": days(20, lambda i: str(i % 2))}
    for reason, rows in reasons.items():
        assert (run(rows).status, run(rows).reason) == ("ineligible", reason)
    assert smooth.trend_competition(spark.createDataFrame([], "t string, v string"), "t", "v").first().status == "ineligible"
