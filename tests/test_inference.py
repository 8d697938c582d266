"""Closed-form grouped statistics against dense least squares and known values."""
import math

import numpy as np
import pandas as pd
import pytest

from ledgerline.functions.dist import f_sf, t_ppf, t_sf2
from ledgerline.operators import inference as I


def test_distribution_values():
    assert t_sf2(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880, abs=1e-6)
    assert f_sf(np.array([3.0]), np.array([2.0]), np.array([20.0]))[0] == pytest.approx(0.0725381, abs=1e-6)
    assert t_ppf(np.array([0.975]), np.array([10.0]))[0] == pytest.approx(2.228139, abs=1e-5)


def make_panel(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in ["p1", "p2"]:
        for lvl, slope in [("a", 0.1), ("b", -0.05), ("c", 0.0)]:
            n = 60
            years = rng.integers(2000, 2008, n) if lvl != "c" else np.full(n, 2003)  # c: constant x
            y = 10 + slope * (years - 2000) + rng.normal(0, 0.5, n)
            rows += [(g, lvl, int(x), float(v), i) for i, (x, v) in enumerate(zip(years, y))]
    return pd.DataFrame(rows, columns=["phase", "sector", "year", "log_amount", "i"])


def test_ols_interaction_matches_lstsq(spark):
    pdf = make_panel()
    res = I.ols_interaction(spark.createDataFrame(pdf), "phase", ["sector"]).toPandas().set_index("phase")
    for g, sub in pdf.groupby("phase"):
        lv = sorted(sub["sector"].unique())
        cols = [np.ones(len(sub)), sub["year"].to_numpy(float)]
        for l in lv[1:]:
            d = (sub["sector"] == l).to_numpy(float)
            cols += [d, d * sub["year"].to_numpy(float)]
        X = np.column_stack(cols)
        y = sub["log_amount"].to_numpy()
        beta, *_ = np.linalg.lstsq(X, y, rcond=None)
        ssr = float(np.sum((y - X @ beta) ** 2))
        sst = float(np.sum((y - y.mean()) ** 2))
        k = np.linalg.matrix_rank(X)
        assert res.loc[g, "k"] == k
        assert res.loc[g, "r2"] == pytest.approx(1 - ssr / sst, rel=1e-9)
        n = len(y)
        llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
        assert res.loc[g, "aic"] == pytest.approx(-2 * llf + 2 * k, rel=1e-9)


def test_ols_tests_run(spark):
    t = I.ols_interaction_tests(spark.createDataFrame(make_panel()), "phase", ["sector"], min_rows=10).toPandas()
    assert len(t) == 2 and t["f_pvalue"].between(0, 1).all()


def test_mediation_matches_lstsq(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.integers(2000, 2010, n).astype(float)
    m = 0.3 * x + rng.normal(0, 1, n)
    y = 0.5 * m + 0.1 * x + rng.normal(0, 1, n)
    pdf = pd.DataFrame({"g": "all", "x": x, "m": m, "y": y})
    e = I.mediation_effects(spark.createDataFrame(pdf), "g", "x", "m", "y").first()
    X = np.column_stack([np.ones(n), x, m])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert e["c_prime_coef"] == pytest.approx(b[1], rel=1e-8)
    assert e["b_coef"] == pytest.approx(b[2], rel=1e-8)
    a = np.polyfit(x, m, 1)[0]
    c = np.polyfit(x, y, 1)[0]
    assert e["a_coef"] == pytest.approx(a, rel=1e-8)
    assert e["c_coef"] - e["c_prime_coef"] == pytest.approx(e["a_coef"] * e["b_coef"], rel=1e-8)  # c - c' = a b
    resid = y - X @ b
    s2 = resid @ resid / (n - 3)
    cov = s2 * np.linalg.inv(X.T @ X)
    assert e["b_t"] == pytest.approx(b[2] / math.sqrt(cov[2, 2]), rel=1e-6)


def test_welch_and_anova(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(10, 2, 80), rng.normal(11, 4, 50)
    pdf = pd.DataFrame({"g": ["A"] * 80 + ["B"] * 50, "v": np.concatenate([a, b])})
    r = I.welch_ttest_tests(spark.createDataFrame(pdf), "g", "v").first()
    se = math.sqrt(a.var(ddof=1) / 80 + b.var(ddof=1) / 50)
    assert r["t"] == pytest.approx((a.mean() - b.mean()) / se, rel=1e-9)
    assert 0 < r["p_value"] < 1 and r["ci_low"] < a.mean() - b.mean() < r["ci_high"]
    an = I.welch_anova_tests(spark.createDataFrame(pdf), "g", "v").first()
    # two groups: Welch F equals t^2 and df2 equals the Welch dof
    assert an["f_stat"] == pytest.approx(r["t"] ** 2, rel=1e-9)
    assert an["df2"] == pytest.approx(r["dof"], rel=1e-9)
    assert an["p_value"] == pytest.approx(r["p_value"], rel=1e-6)


def test_box_and_outliers(spark):
    vals = list(range(1, 21)) + [100]
    pdf = pd.DataFrame({"g": "x", "v": [float(v) for v in vals], "deal_id": range(len(vals))})
    df = spark.createDataFrame(pdf)
    b = I.box_summary(df, "g", "v").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert (b["q1"], b["q3"]) == (q1, q3)
    assert b["whisker_hi"] == 20.0
    o = [r["v"] for r in I.outlier_tags(df, "g", "v").collect()]
    assert o == [100.0]


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 300,
                        "v": np.concatenate([rng.normal(0, 1, 500), rng.normal(5, 2, 300)])})
    d = I.grouped_density(spark.createDataFrame(pdf), "g", "v").toPandas()
    for g, sub in d.groupby("g"):
        sub = sub.sort_values("x")
        step = np.diff(sub["x"]).min()
        assert (sub["density"].sum() * step) == pytest.approx(1.0, abs=0.01)


def test_holm_adjustment(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c", "d"], 40),
                        "v": np.concatenate([rng.normal(m, 1, 40) for m in (0, 0.2, 0.8, 1.5)])})
    t = I.pairwise_groups_tests(spark.createDataFrame(pdf), "g", "v").toPandas().sort_values("p_value")
    p = t["p_value"].to_numpy()
    m = len(p)
    holm = np.minimum(1, np.maximum.accumulate((m - np.arange(m)) * p))
    np.testing.assert_allclose(t["p_holm"].to_numpy(), holm)


def test_holm_in_blocks(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(300) ** 3, [0.01] * 20, [1.0, 0.0]])
    df = spark.createDataFrame([(i, i + 1, float(x)) for i, x in enumerate(p)] + [(900, 901, None)], "group_a int, group_b int, p_value double")
    got = I.holm(df, rows_per_block=7).toPandas().sort_values(["p_value", "group_a"])
    s = np.sort(p)
    np.testing.assert_allclose(got.p_holm.to_numpy()[:len(p)], np.minimum(1, np.maximum.accumulate((len(p) - np.arange(len(p))) * s)))
    assert np.isnan(got.p_holm.to_numpy()[-1]) and len(got) == len(p) + 1


def test_studentized_range_known_values():
    from ledgerline.functions.dist import range_sf, t_sf2
    # two groups: q = t sqrt(2) of Student's t
    t, dof = np.array([0.3, 1.0, 2.2, 5.0]), np.array([3.0, 8.0, 20.0, 400.0])
    np.testing.assert_allclose(range_sf(t * 2 ** 0.5, np.full(4, 2), dof), t_sf2(t, dof), atol=1e-8)
    # published 5 % points: (groups, dof) -> q
    for (k, nu), q in {(3, 10): 3.877, (4, 20): 3.958, (5, 60): 3.977, (10, 120): 4.560}.items():
        assert range_sf(np.array([q]), np.array([k]), np.array([nu]))[0] == pytest.approx(0.05, abs=2e-4)


def test_density_equals_direct_sum(spark):
    rng = np.random.default_rng(4)
    frames = {"a": rng.lognormal(3, 1, 700), "b": np.array([5.0]), "c": np.array([2.0, 2.0, 2.0, 9.0])}
    pdf = pd.DataFrame([(g, float(x)) for g, v in frames.items() for x in v], columns=["g", "v"])
    got = I.grouped_density(spark.createDataFrame(pdf), "g", "v").toPandas()
    bw = {r.g: r for r in I.bandwidths(spark.createDataFrame(pdf), "g", "v").collect()}
    for g, v in frames.items():
        b = bw[g].bw
        lo, step = v.min() - 3 * b, (v.max() - v.min() + 6 * b) / 511
        at = (v - lo) / step
        i = np.minimum(np.floor(at), 510).astype(int)
        c = np.zeros(512)
        np.add.at(c, i, 1 - (at - i))
        np.add.at(c, i + 1, at - i)
        d = np.arange(512)
        want = (c[None, :] * np.exp(-0.5 * ((d[:, None] - d[None, :]) * step / b) ** 2)).sum(1)
        sub = got[got.g == g].sort_values("grid_index")
        assert len(sub) == 512
        np.testing.assert_allclose(sub.weight, want, atol=1e-9)
        np.testing.assert_allclose(sub.x, lo + d * step)


def test_interaction_far_from_zero(spark):
    """Centred moments merge without cancellation: the fit of values near 1e9 is that of the values themselves."""
    pdf = make_panel()
    near = I.ols_interaction(spark.createDataFrame(pdf), "phase", ["sector"], min_rows=10).toPandas().sort_values("phase")
    pdf["log_amount"] = pdf["log_amount"] + 1e9
    far = I.ols_interaction(spark.createDataFrame(pdf).repartition(7), "phase", ["sector"], min_rows=10).toPandas().sort_values("phase")
    np.testing.assert_allclose(far.r2, near.r2, rtol=1e-5)
    two = I.ols_interaction_tests(spark.createDataFrame(make_panel()), "phase", ["sector", "phase"], min_rows=10)
    shuffles = two._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles <= 4
