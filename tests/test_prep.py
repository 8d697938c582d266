"""Splits, folds and metrics against brute force."""
import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import prep as P


def test_auc_pr_calibration(spark):
    rng = np.random.default_rng(0)
    n = 500
    score = np.round(rng.random(n), 2)          # many ties
    label = (rng.random(n) < score).astype(int)
    pdf = pd.DataFrame({"label": label, "score": score})
    df = spark.createDataFrame(pdf)
    auc = P.roc_auc(df, "label", "score").first()["auc"]
    pos, neg = score[label == 1], score[label == 0]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc == pytest.approx(brute, rel=1e-12)
    pr = P.pr_curve(df, "label", "score").toPandas().sort_values("threshold")
    for _, r in pr.sample(20, random_state=1).iterrows():
        sel = score >= r["threshold"]
        assert r["precision"] == pytest.approx(label[sel].mean())
        assert r["recall"] == pytest.approx(label[sel].sum() / label.sum())
    cal = P.calibration_curve(df, "label", "score").toPandas().set_index("bin")
    edges = np.linspace(0, 1, 11)[1:-1]
    ids = np.searchsorted(edges, score)
    for b in np.unique(ids):
        assert cal.loc[b, "prob_true"] == pytest.approx(label[ids == b].mean())


def test_split_and_folds(spark):
    pdf = pd.DataFrame({"deal_id": np.arange(1000), "y": (np.arange(1000) % 4 == 0).astype(int),
                        "year": 2000 + np.arange(1000) // 150})
    df = spark.createDataFrame(pdf)
    s = P.split_stratified(df, "y").toPandas()
    for c, sub in s.groupby("y"):
        assert sub["is_test"].sum() == round(0.3 * len(sub))
    f = P.folds_stratified(df, "y", 5).toPandas()
    sizes = f.groupby(["y", "fold"]).size()
    for c in (0, 1):
        assert sizes.loc[c].max() - sizes.loc[c].min() <= 1
    e = P.folds_expanding(df, 5).toPandas().sort_values("position")
    ts = 1000 // 6
    assert e["position"].tolist() == list(range(1000))
    for i in range(5):
        start = 1000 - (5 - i) * ts
        assert (e.loc[e["test_fold"] == i, "position"] == np.arange(start, start + ts)).all()
        assert set(e.loc[e["first_train_fold"] <= i, "position"]) == set(range(start))


def test_prep_matches_definitions(spark):
    pdf = pd.DataFrame({"deal_id": range(6), "x": [1.0, None, 3.0, 4.0, None, 10.0], "c": ["b", "a", None, "b", "a", "c"]})
    df = spark.createDataFrame(pdf)
    ns, lv = P.fit_numeric(df, ["x"]), P.fit_levels(df, ["c"])
    assert lv["c"] == ["Missing", "a", "b", "c"]
    t = P.prep_tree(df, ns, lv, ["deal_id"]).toPandas().sort_values("deal_id")
    imp = pdf["x"].fillna(pdf["x"].median())
    np.testing.assert_allclose(t["x"], (imp - imp.mean()) / imp.std(ddof=0))
    assert t["c_ord"].tolist() == [2, 1, 0, 2, 1, 3]
    unseen = spark.createDataFrame([(9, 1.0, "zz")], "deal_id long, x double, c string")
    assert P.prep_tree(unseen, ns, lv, ["deal_id"]).first()["c_ord"] == -1
    lin = P.prep_linear(unseen, ns, lv, ["deal_id"]).first()
    assert sum(lin[f"c={v}"] for v in lv["c"]) == 0
