"""Per-series fits: planted parameters, gaps, and dense least squares."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import series as SE


def month(i):
    return dt.date(1990 + i // 12, i % 12 + 1, 1)


def test_arima_recovers_parameters_and_forecasts(spark):
    frames, truth = [], {"a": (0.6, 0.4), "b": (-0.3, 0.5), "c": (0.7, -0.4)}
    n, paths = 2400, {}
    for k, (phi, theta) in truth.items():
        rng = np.random.default_rng(ord(k))
        e, d = rng.normal(0, 0.05, n), np.zeros(n)
        for t in range(1, n):
            d[t] = 0.002 + phi * d[t - 1] + e[t] + theta * e[t - 1]
        paths[k] = 300 + np.cumsum(d)
        frames.append(pd.DataFrame({"key": k, "ds": [month(i) for i in range(n)], "y": np.expm1(paths[k])}))
    s = spark.createDataFrame(pd.concat(frames))
    fits = {r.key: r for r in SE.arima_fit(s, "key").collect()}
    steps = SE.forecast_arima_many(s, "key").orderBy("step").collect()
    for k, (phi, theta) in truth.items():
        f = fits[k]
        assert f.phi == pytest.approx(phi, abs=0.1) and f.theta == pytest.approx(theta, abs=0.1)
        assert f.sigma2 == pytest.approx(0.0025, rel=0.1) and f.n == n - 1 - SE.LONG_LAGS - 1
        d = np.diff(np.log1p(np.expm1(paths[k])))
        e = 0.0
        for t in range(1, len(d)):  # the recursion that the closed form sums up
            e = d[t] - f.const - f.phi * d[t - 1] - f.theta * e
        value, diff, total, weight = paths[k][-1], d[-1], 0.0, 0.0
        for h, r in enumerate([r for r in steps if r.key == k]):
            diff = f.const + f.phi * diff + (f.theta * e if h == 0 else 0)
            value += diff
            weight += 1.0 if h == 0 else f.phi ** (h - 1) * (f.phi + f.theta)
            total += weight ** 2
            assert r.log_forecast == pytest.approx(value, abs=1e-8)
            assert r.log_upper - r.log_lower == pytest.approx(2 * SE.Z95 * np.sqrt(f.sigma2 * total), rel=1e-9)


def test_gaps_are_filled_and_short_series_kept(spark):
    rows = [("a", dt.date(2000, 1, 1), 5.0), ("a", dt.date(2000, 4, 1), 7.0), ("b", dt.date(2000, 2, 1), 1.0)]
    s = spark.createDataFrame(rows, "key string, ds date, y double")
    got = [(r.key, r.ds.month, r.t, r.y) for r in SE.filled(s, "key").orderBy("key", "ds").collect()]
    assert got == [("a", 1, 0, 5.0), ("a", 2, 1, 0.0), ("a", 3, 2, 0.0), ("a", 4, 3, 7.0), ("b", 2, 0, 1.0)]
    fits = {r.key: r for r in SE.arima_fit(s, "key").collect()}
    assert set(fits) == {"a", "b"} and fits["b"].phi is None
    spine = SE.future_spine(s, "key")
    assert SE.trend_season(s, spine, "key").count() == 5 + 10


def test_trend_and_season_equal_dense_ridge(spark):
    rng = np.random.default_rng(2)
    n = 77
    at = np.arange(n) / (n - 1)
    ly = 5 + at - 3 * np.maximum(at - 0.4, 0) + np.tile(rng.normal(0, 0.3, 12), 7)[:n] + rng.normal(0, 0.05, n)
    s = spark.createDataFrame(pd.DataFrame({"key": "a", "ds": [month(i) for i in range(n)], "y": np.expm1(ly)}))
    got = SE.trend_season(s, SE.future_spine(s, "key"), "key").orderBy("ds").toPandas()
    line = [np.ones(n), at, *[np.maximum(at - 0.8 * (k + 1) / (SE.CHANGES + 1), 0) for k in range(SE.CHANGES)]]
    turn = 2 * np.pi * (np.arange(n) % 12) / 12
    x = np.stack([*line, *[f(k * turn) for k in range(1, SE.WAVES + 1) for f in (np.sin, np.cos)]], axis=1)
    ridge = np.diag([1e-6, 1e-6] + [SE.CHANGE_RIDGE] * SE.CHANGES + [SE.WAVE_RIDGE] * 2 * SE.WAVES)
    beta = np.linalg.solve(x.T @ x + ridge, x.T @ ly)
    hist = got[~got.is_forecast]
    np.testing.assert_allclose(hist.yhat, x @ beta, atol=1e-9)
    np.testing.assert_allclose(hist.trend, x[:, :len(line)] @ beta[:len(line)], atol=1e-9)
    np.testing.assert_allclose(hist.yhat_upper - hist.yhat, SE.Z95 * np.sqrt(((ly - x @ beta) ** 2).sum() / (n - 1)), rtol=1e-9)
    assert got.is_forecast.sum() == 5 and got[got.is_forecast].ds.map(lambda d: d.month).eq(12).all()


def test_elimination_solves_and_refuses(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 5))
    y = rng.normal(size=40)
    rows = [("ok", *map(float, r), float(v)) for r, v in zip(a, y)] + [("flat", *[float(r[0])] * 5, float(v)) for r, v in zip(a, y)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double, e double, y double")
    from pyspark.sql import functions as F
    g = SE.gram(df, "k", [F.col(c) for c in "abcde"], F.col("y"))
    got = {r.k: r.b for r in g.select("k", SE.solved(F.col("m"), 5).alias("b")).collect()}
    np.testing.assert_allclose(got["ok"], np.linalg.lstsq(a, y, rcond=None)[0], rtol=1e-9)
    assert got["flat"] is None
