"""Driver contract on the smallest data: entry runs, keys line up, every registered key runs and equals its SQL."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from ledgerline.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
load_all()
#: The searches run the same race on small grids here.
SEARCHES = ["tune_regression", "tune_classification", "feature_attribution", "attribution_identity"]


@pytest.fixture(scope="module")
def con():
    from oracle_check import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_and_keys(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["phase", "hhi", "band"]
    assert df.count() == 3
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)
    assert len(q) >= 150


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in SEARCHES])
def test_every_key(spark, con, key):
    from oracle_check import rows_of
    df = QUERIES[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        assert rows
        return
    rel = con.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())


def test_searches(spark, con, monkeypatch):
    from oracle_check import rows_of
    from ledgerline.operators import models as MD
    monkeypatch.setattr(MD, "REG_GRID", {"gbt": MD.axes(maxDepth=[3], maxIter=[5, 1]), "rf": MD.axes(maxDepth=[4], numTrees=[4])})
    monkeypatch.setattr(MD, "CLF_GRID", {"gbt": MD.axes(maxDepth=[2], maxIter=[4, 1]), "rf": MD.axes(maxDepth=[4], numTrees=[4])})
    found = QUERIES["tune_regression"](spark, SF).collect()
    assert len(found) == 3 and sum(r.is_best for r in found) == 1
    best, = [r for r in found if r.is_best]
    assert best.folds_seen == 5 and best.rmse_log > 0 and all(r.mape >= best.mape for r in found if r.folds_seen == 5)
    folds = {r.fold: (r.n_train, r.n_test) for r in QUERIES["search_fold_rows"](spark, SF).collect()}
    assert best.n_oof == sum(n for _, n in folds.values())
    assert {r.feature for r in QUERIES["feature_attribution"](spark, SF).collect()} >= {"year", "sector_ord"}
    df = QUERIES["attribution_identity"](spark, SF)
    rel = con.sql(ORACLES["attribution_identity"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
    classes = QUERIES["tune_classification"](spark, SF).collect()
    assert len(classes) == 3 and sum(r.is_best for r in classes) == 1 and all(r.cv_auc for r in classes if r.folds_seen == 5)
