"""Model-side identities and planted truths."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ledgerline.operators import models as MD


def test_attributions_add_up(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({"deal_id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n),
                        "s": rng.choice(["x", "y"], n)})
    pdf["y"] = 2 * pdf["a"] - pdf["b"] + (pdf["s"] == "x") * 0.5
    df = spark.createDataFrame(pdf)
    full, = MD.design(df, [], ["a", "b"], ["s"], "y", ["deal_id"])
    m = GBTRegressor(maxDepth=3, maxIter=10, seed=1).fit(full)
    phi = MD.attributions(full, m, ["a", "b", "s_ord"])
    tot = phi.groupBy("deal_id").agg((F.sum("phi") + F.first("base")).alias("recon"))
    pred = m.transform(full).select("deal_id", "prediction")
    d = tot.join(pred, "deal_id").toPandas()
    np.testing.assert_allclose(d["recon"], d["prediction"], atol=1e-9)


def test_the_winner_of_the_search_is_attributed(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"deal_id": np.arange(200), "a": rng.normal(size=200), "b": rng.normal(size=200), "s": rng.choice(["x", "y"], 200)})
    pdf["y"] = 3 * pdf["a"] + pdf["b"]
    full, = MD.design(spark.createDataFrame(pdf), [], ["a", "b"], ["s"], "y", ["deal_id"])
    kind = "model string, params string, is_best boolean"
    for best, name, trees, depth in ((0, "rf", 7, 4), (1, "gbt", 6, 2)):
        rows = [("rf", '{"maxDepth": 4, "numTrees": 7}', best == 0), ("gbt", '{"maxDepth": 2, "maxIter": 6, "stepSize": 0.2}', best == 1)]
        m = MD.refit_winner(spark.createDataFrame(rows, kind), full)
        assert type(m).__name__.lower().startswith({"rf": "randomforest", "gbt": "gbt"}[name])
        assert m.getNumTrees == trees and m.getMaxDepth() == depth
        worst = MD.attribution_sums(m.transform(full), m, ["a", "b", "s_ord"]).agg(F.max("max_error")).first()[0]
        assert worst < 1e-9


def test_attribution_queries_use_the_search(spark, monkeypatch):
    from ledgerline.plans import catalog_models as C
    kind = "model string, params string, rmse_log double, mape double, n_oof long, is_best boolean"
    won = spark.createDataFrame([("rf", '{"maxDepth": 3, "numTrees": 5}', 1.0, 1.0, 1, True)], kind)
    monkeypatch.setattr(C, "_search", lambda spark, sf: won)
    full, every, model, names = C._attributed(spark, "/root/testdata/sf0.001")
    assert type(model).__name__ == "RandomForestRegressionModel" and model.getNumTrees == 5
    f = C.feat(spark, "/root/testdata/sf0.001").where("log_amount is not null")
    assert every.count() == f.count()
    assert full.count() == f.dropna(subset=[*C.P.ML_NUMERIC, *C.P.ML_CATEGORICAL]).count()


def test_residual_effect_recovers_theta(spark):
    rng = np.random.default_rng(1)
    rt = rng.normal(size=2000)
    ry = 0.7 * rt + rng.normal(0, 0.1, 2000)
    r = spark.createDataFrame(pd.DataFrame({"ry": ry, "rt": rt}))
    e = MD.residual_effect(r).first()
    assert e["effect_log"] == pytest.approx(0.7, abs=0.01)
    assert e["p_value"] < 1e-6 and e["ci_low"] < 0.7 < e["ci_high"]


def brute_shapley(trees, x, n):
    """Shapley values by all coalitions: a split on a feature outside follows both sides by their covers."""
    from itertools import combinations
    from math import factorial

    def value(t, inside, at=0):
        if t.left[at] < 0:
            return t.value[at]
        lo, hi, f = t.left[at], t.right[at], t.feature[at]
        if f in inside:
            return value(t, inside, lo if x[f] <= t.threshold[at] else hi)
        return (t.cover[lo] * value(t, inside, lo) + t.cover[hi] * value(t, inside, hi)) / t.cover[at]

    phi = np.zeros(n)
    for j in range(n):
        rest = [f for f in range(n) if f != j]
        for k in range(n):
            for s in combinations(rest, k):
                w = factorial(k) * factorial(n - 1 - k) / factorial(n)
                phi[j] += w * sum(t.weight * (value(t, {*s, j}) - value(t, set(s))) for t in trees)
    return phi


@pytest.mark.parametrize("tabulated", [8, 1])
def test_shapley_values_equal_all_coalitions(spark, monkeypatch, tabulated):
    from pyspark.ml.regression import RandomForestRegressor
    from ledgerline.operators import shapley as S
    monkeypatch.setattr(S, "TABULATED", tabulated)
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"deal_id": np.arange(n), **{c: rng.normal(size=n) for c in "abc"}, "s": rng.choice(["x", "y", "z"], n)})
    pdf["y"] = pdf["a"] * pdf["b"] + (pdf["s"] == "x") * pdf["c"]
    full, = MD.design(spark.createDataFrame(pdf), [], ["a", "b", "c"], ["s"], "y", ["deal_id"])
    x = np.array([r.features.toArray() for r in full.orderBy("deal_id").collect()])
    for m in (GBTRegressor(maxDepth=4, maxIter=4, seed=1).fit(full), RandomForestRegressor(maxDepth=5, numTrees=3, seed=2).fit(full)):
        trees = MD.tree_tables(m)
        phi, base = S.credits(trees, 4)(x)
        for i in range(0, n, 37):
            np.testing.assert_allclose(phi[i], brute_shapley(trees, x[i], 4), atol=1e-10)
        pred = np.array([r.prediction for r in m.transform(full).orderBy("deal_id").collect()])
        np.testing.assert_allclose(phi.sum(1) + base, pred, atol=1e-9)
        np.testing.assert_allclose(S.predicted(trees, x), pred, atol=1e-9)


def test_race_drops_only_the_clearly_worse():
    rng = np.random.default_rng(5)
    loss = {k: rng.normal(q, 0.3, (3, 200)) + rng.normal(0, 2, (3, 200)).cumsum(0) * 0 for k, q in enumerate((1.0, 1.01, 3.0, 0.9))}
    settings = [("a", {"k": 0}), ("a", {"k": 1}), ("b", {"k": 2}), ("b", {"k": 3})]

    def losses(model, leader, fold):
        e, d = loss[model][fold], loss[model][fold] - loss[leader][fold]
        return len(e), e.sum(), d.sum(), (d * d).sum()

    stats, left = MD.race(settings, [0, 1, 2], lambda s, fold: s[1]["k"], losses, 2)
    assert 3 in left and 2 not in left and stats[2]["folds"] < 3 and stats[3]["folds"] == 3
    assert min(left, key=lambda k: stats[k]["loss"]) == 3 and left[3] == [3, 3, 3]


def test_one_fit_holds_its_smaller_settings(spark):
    rng = np.random.default_rng(6)
    n = 600
    pdf = pd.DataFrame({"deal_id": np.arange(n), **{c: rng.normal(size=n) for c in "abcde"}, "s": rng.choice(["x", "y"], n)})
    pdf["y"] = pdf["a"] * 2 + pdf["b"] * pdf["c"] + rng.normal(0, 0.3, n)
    pdf["c01"] = (pdf["y"] > 0.4).astype(int)
    forests = MD.axes(maxDepth=[5, 3], numTrees=[4], featureSubsetStrategy=["onethird", "all"], minInfoGain=[0.0, 0.05])
    boosted = MD.axes(maxDepth=[2], maxIter=[6, 2], stepSize=[0.3], subsamplingRate=[0.7])
    for label, make, kinds, fewest in (("y", MD._regressor, ("gbt", "rf"), 4), ("c01", MD._classifier, ("gbt", "gbt_weighted", "rf"), 5)):
        full, = MD.design(spark.createDataFrame(pdf), [], list("abcde"), ["s"], label, ["deal_id"])
        full = full.withColumn("weight", F.col("label") + 1).coalesce(1).persist()
        x = np.array([r.features.toArray() for r in full.orderBy("deal_id").collect()])
        settings = [(kind, p) for kind in kinds for p in (forests if kind == "rf" else boosted)]
        fits = MD.Fits(settings, lambda i: full, make, 4)
        models = fits.models(settings, 0)
        assert len(fits.done) == fewest  # boosting by family; forests: drawn features keep their least gain apart
        for setting, m in zip(settings, models):
            alone = make(*setting).fit(full).transform(full).orderBy("deal_id")
            if label == "c01":
                alone = alone.withColumn("prediction", MD.vector_to_array("probability")[1])
            score, = MD.scored([m], x)
            np.testing.assert_allclose(score, [r.prediction for r in alone.collect()], atol=1e-9, err_msg=str(setting))
        fits.end()


def test_losses_of_many_models_in_one_pass(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"deal_id": np.arange(300), "a": rng.normal(size=300), "b": rng.normal(size=300), "s": "x"})
    pdf["y"] = pdf["a"] - pdf["b"]
    full, = MD.design(spark.createDataFrame(pdf), [], ["a", "b"], ["s"], "y", ["deal_id"])
    one, two = (MD.ensemble(GBTRegressor(maxDepth=2, maxIter=k, seed=1).fit(full)) for k in (2, 5))
    x = np.array([r.features.toArray() for r in full.orderBy("deal_id").collect()])
    y = pdf["y"].to_numpy()
    a, b = MD.scored([one, two], x)
    own, other = MD.paired_losses(full.repartition(3), [one, two], two, lambda y, p: np.abs(y - p))
    d = np.abs(y - a) - np.abs(y - b)
    np.testing.assert_allclose(own, [300, np.abs(y - a).sum(), d.sum(), (d * d).sum(), ((y - a) ** 2).sum()])
    assert other[:1] == (300,) and other[2:4] == (0.0, 0.0)
    rows = {(r.setting, r.deal_id): r.score for r in MD.scores(full, {4: one, 9: two}, [("deal_id", "long")]).collect()}
    assert len(rows) == 600 and all(rows[4, i] == pytest.approx(a[i]) and rows[9, i] == pytest.approx(b[i]) for i in range(300))


def test_predictions_follow_each_row_to_its_leaf():
    """A lone leaf, a chain of 20 splits and a wide tree, on rows with infinities and missing values, against a walk row by row."""
    from ledgerline.operators import shapley as S
    rng = np.random.default_rng(8)

    def grown(depth, one_sided):
        left, right, feature, threshold, value = [], [], [], [], []

        def add(d):
            me = len(left)
            for a, v in zip((left, right, feature, threshold, value), (-1, -1, -1, 0.0, rng.normal())):
                a.append(v)
            if d:
                feature[me], threshold[me] = int(rng.integers(4)), float(rng.normal())
                left[me], right[me] = add(0 if one_sided else d - 1), add(d - 1)
            return me

        add(depth)
        return S.Tree(0.5, left, right, feature, threshold, value, [])

    trees = [grown(0, False), grown(20, True), grown(5, False)]
    x = rng.normal(size=(300, 4))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0], x[1] = np.inf, -np.inf

    def walked(t, row):
        at = 0
        while t.left[at] >= 0:
            at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
        return t.weight * t.value[at]

    np.testing.assert_allclose(S.predicted(trees, x), [sum(walked(t, row) for t in trees) for row in x], rtol=1e-12)
    assert S.predicted(trees, x[:0]).shape == (0,)


def _search_rows(spark, n=600):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"deal_id": np.arange(n), "year": 1995 + np.arange(n) // 100, "a": rng.normal(size=n), "b": rng.normal(size=n), "s": rng.choice(["x", "y"], n)})
    pdf["y"] = 3 + 2 * pdf["a"] - pdf["b"] + rng.normal(0, 0.1, n)
    pdf["c01"] = (pdf["y"] > 3.5).astype(int)
    return spark.createDataFrame(pdf)


def test_regression_search_scores_every_setting_on_every_fold(spark):
    """Settings that are far worse on the first fold are fitted and scored on all others too."""
    grid = {"gbt": MD.axes(maxDepth=[3], maxIter=[10, 1], stepSize=[0.3, 0.01]), "rf": MD.axes(maxDepth=[4, 1], numTrees=[3])}
    summary, preds = MD.tune_regression(_search_rows(spark), "y", ["a", "b"], ["s"], 3, grid)
    rows = summary.collect()
    assert len(rows) == 6 and [(r.folds_seen, r.n_oof) for r in rows] == [(3, 450)] * 6
    assert all(r.rmse_log > 0 for r in rows) and max(r.mape for r in rows) > 1.5 * min(r.mape for r in rows)
    best, = [r for r in rows if r.is_best]
    assert best.mape == min(r.mape for r in rows)
    p = preds.toPandas()
    assert sorted(p["fold"].unique()) == [0, 1, 2] and p["deal_id"].is_unique and len(p) == 450
    assert ((p["label"] - p["prediction"]) ** 2).mean() ** 0.5 == pytest.approx(best.rmse_log)


def test_classification_search_scores_every_setting_on_every_fold(spark):
    grid = {"gbt": MD.axes(maxDepth=[3, 1], maxIter=[8, 1], stepSize=[0.3]), "rf": MD.axes(maxDepth=[4, 1], numTrees=[3])}
    summary, preds = MD.tune_classification(_search_rows(spark), "c01", ["a", "b"], ["s"], 3, grid)
    rows = summary.collect()
    assert len(rows) == 6 and {r.folds_seen for r in rows} == {3} and len({r.n_oof for r in rows}) == 1 and 400 < rows[0].n_oof < 440
    assert all(0.5 < r.cv_auc <= 1 and r.squared_error > 0 for r in rows) and max(r.cv_auc for r in rows) > min(r.cv_auc for r in rows) + 0.05
    refitted = [r for r in rows if r.accuracy is not None]
    assert sorted(r.model for r in refitted) == ["gbt", "rf"]
    assert all(r.cv_auc == max(o.cv_auc for o in rows if o.model == r.model) for r in refitted)
    best, = [r for r in rows if r.is_best]
    p = preds.toPandas()
    assert best.roc_auc == max(r.roc_auc for r in refitted) and len(p) + best.n_oof == 600
    assert (p["label"] == p["prediction"]).mean() == pytest.approx(best.accuracy)


@pytest.mark.parametrize("rows_per_range", [200_000, 7])
def test_ranked_counts_every_pair(spark, monkeypatch, rows_per_range):
    """AUC and squared error of several models, with many ties, against all pairs; ranges of any size give the same."""
    monkeypatch.setattr(MD, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(MD, "BOUND_ROWS", 30)
    df = _search_rows(spark, 200)
    full, = MD.design(df, [], ["a", "b"], ["s"], "c01", ["deal_id"])
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    models = [MD.ensemble(m.fit(full)) for m in (GBTClassifier(maxDepth=3, maxIter=4, seed=1), GBTClassifier(maxDepth=1, maxIter=1, seed=1),
                                                 RandomForestClassifier(maxDepth=2, numTrees=3, seed=1))]
    rows = full.orderBy("deal_id").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    for (n, square, auc), p in zip(MD.ranked(full.repartition(3), models), MD.scored(models, x)):
        d = p[y == 1][:, None] - p[y == 0][None, :]
        assert n == 200 and square == pytest.approx(((p - y) ** 2).sum())
        assert auc == pytest.approx(((d > 0) + (d == 0) / 2).mean(), abs=1e-12)
    assert [r[2] for r in MD.ranked(full.where("label = 1"), models)] == [None] * 3
    assert MD.ranked(full.where("label = 9"), models) == [(0, 0.0, None)] * 3


def test_fits_keep_no_more_copies_than_the_cores_need(spark, monkeypatch):
    """Every running fit holds a copy of its rows: on many partitions one runs at a time, on one partition several do."""
    import threading
    import time
    monkeypatch.setattr(MD, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(MD, "ensemble", lambda model, spark: MD.Ensemble([]))
    settings = [("gbt", {"maxDepth": d}) for d in range(1, 7)]
    for parts, fewest, most in ((16, 1, 1), (1, 2, 4)):
        rows = spark.range(0, 10 * parts, 1, parts).persist()
        rows.count()
        running, seen, lock, cached = [0], [], threading.Lock(), []

        class Estimator:
            def fit(self, df):
                with lock:
                    running[0] += 1
                    seen.append(running[0])
                    cached.append(spark.sparkContext._jsc.getPersistentRDDs().size())
                time.sleep(0.2)
                with lock:
                    running[0] -= 1

        before = spark.sparkContext._jsc.getPersistentRDDs().size()
        fits = MD.Fits(settings, lambda i: rows, lambda *s: Estimator(), 4)
        assert len(fits.models(settings, 0)) == 6 and fewest <= max(seen) <= most
        assert set(cached) == {before}  # the table is persisted, its folds are not
        fits.end()
        rows.unpersist()


def test_fits_whose_splits_no_limit_bars_are_shared(spark):
    """Settings under stricter limits get the looser fit only where it is what their own fit gives, and a lower number of fits."""
    rng = np.random.default_rng(10)
    n = 800
    pdf = pd.DataFrame({"deal_id": np.arange(n), **{c: rng.normal(size=n) for c in "abcde"}, "s": rng.choice(["x", "y"], n)})
    pdf["y"] = pdf["a"] * 2 + pdf["b"] * pdf["c"] + rng.normal(0, 0.3, n)
    pdf["c01"] = (pdf["y"] > 0.4).astype(int)
    boosted = MD.axes(maxDepth=[2], maxIter=[4], minInstancesPerNode=[1, 3, 200])
    forests = MD.axes(maxDepth=[3, 2], numTrees=[3], featureSubsetStrategy=["onethird", "all"], minInstancesPerNode=[1, 3, 150], minInfoGain=[0.0, 0.0001, 0.3])
    for label, make, kinds in (("y", MD._regressor, ("gbt", "rf")), ("c01", MD._classifier, ("gbt", "rf"))):
        full, = MD.design(spark.createDataFrame(pdf), [], list("abcde"), ["s"], label, ["deal_id"])
        full = full.coalesce(1).persist()
        x = np.array([r.features.toArray() for r in full.orderBy("deal_id").collect()])
        settings = [(kind, p) for kind in kinds for p in (forests if kind == "rf" else boosted)]
        asked = []
        fits = MD.Fits(settings, lambda i: full, lambda *s: asked.append(s) or make(*s), 4)
        models = fits.models(settings, 0)
        assert len(fits.done) == 3 + 3 + 9  # boosted; forests of all features hold their least gain; drawn features
        assert len(asked) < len(fits.done) - 2 if label == "y" else len(asked) == 2 + 3 + 9
        for setting, m in zip(settings, models):
            alone = make(*setting).fit(full).transform(full).orderBy("deal_id")
            if label == "c01":
                alone = alone.withColumn("prediction", MD.vector_to_array("probability")[1])
            score, = MD.scored([m], x)
            np.testing.assert_allclose(score, [r.prediction for r in alone.collect()], atol=1e-9, err_msg=str(setting))
        if label == "y":
            losses = MD.paired_losses(full, models, None, lambda y, p: np.abs(y - p))
            assert len(losses) == len(models) and all(
                r[1] == pytest.approx(np.abs(pdf["y"] - next(MD.scored([m], x))).sum()) for r, m in zip(losses, models))
        fits.end()
