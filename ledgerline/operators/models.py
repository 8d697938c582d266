"""Model search, cross-fitted effects and attributions on Spark ML.

Every fit is a distributed Spark ML job on one persisted table with a fold column; the
driver has every setting of a grid fitted and scored on every fold (fits run concurrently,
like CrossValidator's ``parallelism``) and sees a few sums per fit. Predictions stay
DataFrames and are scored by the metric operators in ``prep``.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from threading import Semaphore

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sweep
from . import prep as P
from .ordered import written
from .shapley import Tree, credits, predicted

def axes(**values) -> list[dict]:
    """All combinations of the axes' values."""
    return [dict(zip(values, c)) for c in product(*values.values())]


# Two values on every axis: 32 + 128 and 8 + 8 + 16 settings. Pass larger grids for wider searches.
REG_GRID = {
    "gbt": axes(maxDepth=[3, 2], maxIter=[10, 5], stepSize=[0.3, 0.1], subsamplingRate=[1.0, 0.7], minInstancesPerNode=[1, 20]),
    "rf": axes(maxDepth=[6, 4], numTrees=[10, 5], subsamplingRate=[1.0, 0.7], featureSubsetStrategy=["onethird", "all"], minInstancesPerNode=[1, 20],
               maxBins=[32, 16], minInfoGain=[0.0, 0.01]),
}
CLF_GRID = {
    "gbt": axes(maxDepth=[3, 2], maxIter=[10, 5], stepSize=[0.3, 0.1]),
    "gbt_weighted": axes(maxDepth=[3, 2], maxIter=[10, 5], stepSize=[0.3, 0.1]),
    "rf": axes(maxDepth=[6, 4], numTrees=[10, 5], featureSubsetStrategy=["onethird", "all"], minInstancesPerNode=[1, 20]),
}
#: Rows of one task of a fit.
ROWS_PER_TASK = 50_000
#: Scores of one range that a task sorts for an AUC, and rows whose scores give the ranges' bounds.
ROWS_PER_RANGE = 200_000
BOUND_ROWS = 5_000
#: A setting is dropped if its mean paired loss against the leader exceeds so many standard errors (one-sided 95 %).
CLEARLY = 1.645


def _regressor(name: str, params: dict):
    if name == "gbt":
        return GBTRegressor(featuresCol="features", labelCol="label", seed=42, **params)
    return RandomForestRegressor(featuresCol="features", labelCol="label", seed=42, **params)


def _classifier(name: str, params: dict):
    if name == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="label", seed=42, **params)
    kw = dict(params)
    if name == "gbt_weighted":
        kw["weightCol"] = "weight"
    return GBTClassifier(featuresCol="features", labelCol="label", seed=42, **kw)


def design(train: DataFrame, other: list[DataFrame], num: list[str], cat: list[str], label: str,
           keep: list[str]) -> list[DataFrame]:
    """Fit preparation (M2) on ``train`` only and apply it to train and others;
    assemble the feature vector."""
    ns = P.fit_numeric(train, num)
    lv = P.fit_levels(train, cat)
    feats = list(num) + [f"{c}_ord" for c in cat]
    va = VectorAssembler(inputCols=feats, outputCol="features")
    out = []
    for d in [train, *other]:
        t = P.prep_tree(d.withColumn("label", F.col(label).cast("double")), ns, lv, keep + ["label"])
        out.append(va.transform(t))
    return out


def prepared(df: DataFrame, first: DataFrame, num: list[str], cat: list[str], label: str, keep: list[str]) -> DataFrame:
    """One prepared table (M2) for all folds: ``keep``, label, features. Medians and scales are those of ``first``, rows that
    every fold trains on; level codes are the table's vocabulary."""
    t = P.prep_tree(df.withColumn("label", F.col(label).cast("double")), P.fit_numeric(first, num), P.fit_levels(df, cat), [*keep, "label"])
    return VectorAssembler(inputCols=[*num, *[f"{c}_ord" for c in cat]], outputCol="features").transform(t).select(*keep, "label", "features")


def _parts(df: DataFrame) -> int:
    return -(-df.count() // ROWS_PER_TASK) or 1


def few_tasks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to unpersist, and ``df`` persisted with at least ROWS_PER_TASK rows a partition: fits are many short jobs, which run side by side. Rows
    are dealt out by hash of ``deal_id`` and label, so that every fold has a like part of every partition, the same in each run."""
    parts = _parts(df)
    if parts > 1:
        df = df.repartition(parts, "deal_id", "label").sortWithinPartitions("deal_id")
    df = df.persist()
    return df, df if parts >= df.rdd.getNumPartitions() else df.coalesce(parts)


def side_by_side(rows: DataFrame, most: int) -> int:
    """Fits of ``rows`` that run at once: each keeps a copy of its rows in Spark's storage, so only as many as it takes to
    have two tasks for every core."""
    return max(1, min(most, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // max(rows.rdd.getNumPartitions(), 1))))


def race(settings: list[tuple[str, dict]], folds: list, fit, losses, parallelism: int, together=None) -> tuple[list[dict], dict[int, list]]:
    """Races settings over folds: on each fold the leader is fitted first, then all others that are left; ``losses(model,
    leader, fold)`` gives n, the sum of the setting's loss, and sum and sum of squares of its loss minus the leader's, row
    by row on the whole fold. Settings whose mean difference over all folds seen under one leader is clearly above 0 are dropped after the
    fold; the rest see the next one. No rows are sampled. The leader is the setting with the lowest loss so far; on the
    first fold, the best of the families' first settings. ``together(settings, leader, fold, next)``, if given, does ``fit``
    and ``losses`` for many settings at once and returns (model, losses) of each; ``next`` are those asked for after them.

    Returns one record per setting (n, loss, folds) and, for those that saw all folds, their models by fold. The queries
    don't use it: their searches are whole (:func:`every_fold`).
    """
    stats = [{"n": 0, "loss": 0.0, "folds": 0} for _ in settings]
    models: dict[int, list] = {k: [] for k in range(len(settings))}
    alive, leader = list(range(len(settings))), None

    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        def each(some: list, against, fold, _) -> list:
            def one(setting):
                model = fit(setting, fold)
                return model, losses(model, against or model, fold)
            return list(ex.map(one, some))

        def entered(ks: list[int], against, fold, after: list[int]) -> list[tuple]:
            out = []
            for k, (model, (n, loss, diff, square)) in zip(ks, (together or each)([settings[k] for k in ks], against, fold, [settings[k] for k in after])):
                models[k].append(model)
                stats[k]["n"] += n
                stats[k]["loss"] += loss
                stats[k]["folds"] += 1
                out.append((n, diff, square))
            return out

        for fold in folds:
            if leader is None:
                names = [name for name, _ in settings]
                ahead = [names.index(name) for name in dict.fromkeys(names)]
                entered(ahead, None, fold, alive)
                leader = min(ahead, key=lambda k: stats[k]["loss"])
            else:
                ahead = [leader]
                entered(ahead, None, fold, alive)
            reference = models[leader][-1]
            rest = [k for k in alive if k not in ahead]
            clear = set()
            for k, (n, diff, square) in zip(rest, entered(rest, reference, fold, []) if rest else []):
                spread = max(square / n - (diff / n) ** 2, 0.0)
                if diff / n > CLEARLY * (spread / n) ** 0.5:
                    clear.add(k)
            alive = [k for k in alive if k not in clear]
            for k in clear:
                models[k] = []
            leader = min(alive, key=lambda k: stats[k]["loss"] / max(stats[k]["n"], 1))
    return stats, {k: models[k] for k in alive}


# ------------------------------------------------------------------ fits that hold several settings
def _held_axes(name: str, params: dict) -> list[str]:
    """The parameters along which a fit holds other settings: a boosted model begins with the trees of the one with fewer
    rounds, and a forest's trees are, up to a depth, those of the shallower forest. The least gain only decides whether the
    best split is made, as long as no features are drawn per node (a draw moves all later ones)."""
    axes_ = ["maxIter"] if name.startswith("gbt") else ["maxDepth"]
    if name == "rf" and params.get("featureSubsetStrategy") == "all":
        axes_.append("minInfoGain")
    return [a for a in axes_ if a in params]


def holders(settings: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """For each setting the one whose fit holds it: most rounds, greatest depth, smallest least gain of its like."""
    wide: dict[tuple, dict] = {}
    keys = []
    for name, params in settings:
        held = _held_axes(name, params)
        key = (name, tuple(held), json.dumps({a: v for a, v in params.items() if a not in held}, sort_keys=True))
        keys.append(key)
        w = wide.setdefault(key, dict(params))
        for a in held:
            w[a] = (min if a == "minInfoGain" else max)(w[a], params[a])
    return [(key[0], wide[key]) for key in keys]


@dataclass(frozen=True)
class Ensemble:
    """Trees whose weighted sum is a prediction or, with ``logistic``, half the log odds of class 1."""
    trees: list[Tree]
    logistic: bool = False

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * total)) if self.logistic else total


def cut(tree: Tree, depth: int, gain: float) -> Tree:
    """``tree`` without splits at ``depth`` or with less than ``gain``. Where nodes have a class (``call``), two leaves of one
    class are merged, as a classifier's fit does."""
    rows: list[list] = []

    def walk(at: int, level: int) -> int:
        me = len(rows)
        rows.append([-1, -1, -1, 0.0, *(a[at] for a in (tree.value, tree.cover, tree.gain)), tree.call[at] if tree.call else None])
        if tree.left[at] >= 0 and level < depth and tree.gain[at] >= gain:
            low, high = walk(tree.left[at], level + 1), walk(tree.right[at], level + 1)
            if tree.call and rows[low][0] < 0 and rows[high][0] < 0 and rows[low][7] == rows[high][7]:
                del rows[me + 1:]
            else:
                rows[me][:4] = low, high, tree.feature[at], tree.threshold[at]
        return me

    walk(0, 0)
    left, right, feature, threshold, value, cover, gains, call = (list(c) for c in zip(*rows))
    return Tree(tree.weight, left, right, feature, threshold, value, cover, gains, call if tree.call else [])


def held(whole: Ensemble, name: str, params: dict) -> Ensemble:
    """The model of a setting out of the fit that holds it (see :func:`holders`)."""
    if name.startswith("gbt"):
        return replace(whole, trees=whole.trees[:params["maxIter"]]) if "maxIter" in params else whole
    if "maxDepth" not in params:
        return whole
    return replace(whole, trees=[cut(t, params["maxDepth"], params.get("minInfoGain", 0.0)) for t in whole.trees])


#: Parameters that only bar splits, and their defaults: a fit takes the best split of a node that none of them bars.
LIMITS = {"minInstancesPerNode": 1, "minInfoGain": 0.0}


def limits(params: dict) -> tuple:
    return tuple(params.get(a, least) for a, least in LIMITS.items())


def unbarred(whole: Ensemble, params: dict) -> bool:
    """Whether none of the fit's splits is barred by ``params``' limits, which are no looser than its own: a fit under them
    would be the same. A leaf has no split to make under looser limits, so it has none under these. Forests of classes
    are never the same: leaves of one class were merged, so some of their splits are not seen."""
    rows, gain = limits(params)
    return all(not t.call and all(lo < 0 or (g >= gain and min(t.rows[lo], t.rows[hi]) >= rows) for lo, hi, g in zip(t.left, t.right, t.gain))
               for t in whole.trees)


def scored(models: list[Ensemble], x: np.ndarray):
    """Each model's scores of the rows ``x``; a tree that several models share is walked once for neighbours."""
    kept: dict[int, np.ndarray] = {}
    for m in models:
        kept = {id(t): kept[id(t)] if id(t) in kept else predicted([t], x) for t in m.trees}
        yield m.score(sum(kept[id(t)] for t in m.trees))


def _bare(models: list[Ensemble]) -> list[Ensemble]:
    """The models without what only :func:`cut` needs, trees still shared: they travel to the tasks."""
    bare: dict[int, Tree] = {}
    for m in models:
        for t in m.trees:
            bare.setdefault(id(t), Tree(t.weight, *(np.asarray(a) for a in (t.left, t.right, t.feature, t.threshold, t.value)), cover=[]))
    return [replace(m, trees=[bare[id(t)] for t in m.trees]) for m in models]


def _matrix(pdf) -> np.ndarray:
    return np.stack(pdf["f"].to_numpy())


def paired_losses(rows: DataFrame, models: list[Ensemble], leader: Ensemble | None, loss: Callable) -> list[tuple]:
    """Per model n, the sum of ``loss(label, score)``, sum and sum of squares of its difference to the leader's (none: to its
    own), and the sum of squared errors, over ``rows`` (label, features), which are read once for all models."""
    of = [id(m) for m in models]
    models = list(dict(zip(of, models)).values())  # settings may share a model
    bare = _bare([*models, *([leader] if leader else [])])

    def fn(it):
        sums = np.zeros((len(bare) - bool(leader), 5))
        for pdf in it:
            if not len(pdf):
                continue
            x, y = _matrix(pdf), pdf["label"].to_numpy()
            led = loss(y, next(scored(bare[-1:], x))) if leader else None
            for k, p in enumerate(scored(bare[:len(sums)], x)):
                e = loss(y, p)
                d = e - (e if led is None else led)
                sums[k] += len(y), e.sum(), d.sum(), (d * d).sum(), ((y - p) ** 2).sum()
        yield pd.DataFrame({"k": range(len(sums)), **{c: sums[:, i] for i, c in enumerate("nabcd")}})

    found = rows.select("label", vector_to_array("features").alias("f")).mapInPandas(fn, "k int, n double, a double, b double, c double, d double")
    by = {r["k"]: tuple(r)[1:] for r in found.groupBy("k").agg(*[F.sum(c) for c in "nabcd"]).collect()}
    at = {m: k for k, m in enumerate(dict.fromkeys(of))}
    return [(int(by[at[m]][0]), *by[at[m]][1:]) for m in of]


def scores(rows: DataFrame, models: dict[int, Ensemble], keep: list[tuple[str, str]]) -> DataFrame:
    """One row per model and row: setting (the model's key), the columns ``keep`` (name, type) and score."""
    names, bare = [c for c, _ in keep], dict(zip(models, _bare(list(models.values()))))

    def fn(it):
        for pdf in it:
            if len(pdf):
                for k, p in zip(bare, scored(list(bare.values()), _matrix(pdf))):
                    yield pdf[names].assign(setting=k, score=p)[["setting", *names, "score"]]

    return rows.select(*names, vector_to_array("features").alias("f")).mapInPandas(
        fn, ", ".join(["setting int", *[f"{c} {t}" for c, t in keep], "score double"]))


def _distinct(score: np.ndarray, *counts: np.ndarray) -> tuple:
    """The distinct scores, ascending, and the sums of the counts by score."""
    at, inverse = np.unique(score, return_inverse=True)
    return at, *(np.bincount(inverse, c, len(at)) for c in counts)


def ranked(rows: DataFrame, models: list[Ensemble]) -> list[tuple]:
    """Per model n, the sum of squared errors of its probability and the rank AUC (M9: ties half, None if a class is empty)
    over ``rows`` (label 0 or 1, features), which are read once for all models. Tasks count rows by distinct score and send
    these packed, split into ranges of about ROWS_PER_RANGE rows. The bounds come from the scores of the first rows: they
    only decide which task sorts what; every row counts, exactly."""
    bare, f = _bare(models), vector_to_array("features").alias("f")
    ranges = -(-rows.count() // ROWS_PER_RANGE)
    head = rows.select(f).limit(BOUND_ROWS).toPandas() if ranges > 1 else []
    bounds = [np.unique(np.quantile(p, np.arange(1, ranges) / ranges)) for p in scored(bare, _matrix(head))] if len(head) else [np.zeros(0)] * len(bare)

    def sent(labels: list, found: list[list]) -> pd.DataFrame:
        y, out = np.concatenate(labels), []
        for k, parts in enumerate(found):
            at, *counts = _distinct(np.concatenate(parts), y, 1 - y)
            ends = np.searchsorted(at, bounds[k])
            for r, cols in enumerate(zip(*(np.split(c, ends) for c in (at, *(c.astype("u4") for c in counts))))):
                if len(cols[0]):
                    out.append((k, r, *(c.tobytes() for c in cols)))
        return pd.DataFrame(out, columns=["k", "r", "at", "pos", "neg"])

    def count(it):
        labels, found, n = [], [[] for _ in bare], 0
        for pdf in it:
            if not len(pdf):
                continue
            x, n = _matrix(pdf), n + len(pdf)
            labels.append(pdf["label"].to_numpy())
            for parts, p in zip(found, scored(bare, x)):
                parts.append(p)
            if n >= ROWS_PER_RANGE:
                yield sent(labels, found)
                labels, found, n = [], [[] for _ in bare], 0
        if n:
            yield sent(labels, found)

    def merge(pdf):
        at, pos, neg = _distinct(*(np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("at", "f8"), ("pos", "u4"), ("neg", "u4"))))
        return pd.DataFrame({"k": pdf["k"][:1], "r": pdf["r"][:1], "pos": pos.sum(), "neg": neg.sum(), "twice": (pos * (2 * (np.cumsum(neg) - neg) + neg)).sum(),
                             "square": (pos * (1 - at) ** 2 + neg * at ** 2).sum()})

    counted = rows.select("label", f).mapInPandas(count, "k int, r int, at binary, pos binary, neg binary")
    merged = counted.groupBy("k", "r").applyInPandas(merge, "k int, r int, pos double, neg double, twice double, square double").collect()
    out = []
    for k in range(len(bare)):
        pos = neg = twice = square = 0.0
        for m in sorted((m for m in merged if m["k"] == k), key=lambda m: m["r"]):
            twice += m["twice"] + 2 * m["pos"] * neg
            pos, neg, square = pos + m["pos"], neg + m["neg"], square + m["square"]
        out.append((int(pos + neg), square, twice / (2 * pos * neg) if pos * neg else None))
    return out


class Fits:
    """Fits of a search: settings held by one fit are fitted once a fold, on that fold's training rows. ``train(fold)`` gives
    the rows, out of a persisted table; ``make(setting)`` the estimator."""

    def __init__(self, settings: list[tuple[str, dict]], train: Callable, make: Callable, parallelism: int):
        self.holder = {json.dumps(s, sort_keys=True): h for s, h in zip(settings, holders(settings))}
        self.train, self.make, self.parallelism = train, make, max(1, parallelism)
        self.fold, self.rows, self.done = None, None, {}

    def begin(self, fold) -> None:
        if self.rows is None or fold != self.fold:
            self.end()
            rows = self.train(fold)
            parts = _parts(rows)
            self.rows = rows if parts >= rows.rdd.getNumPartitions() else rows.coalesce(parts)
            self.slots = Semaphore(side_by_side(self.rows, self.parallelism))
            self.fold = fold

    def end(self) -> None:
        self.rows, self.done = None, {}

    def _fitted(self, setting: tuple[str, dict]) -> Ensemble:
        with self.slots:
            model = self.make(*setting).fit(self.rows)
        return ensemble(model, self.rows.sparkSession)

    def _family(self, like: list[tuple[str, tuple[str, dict]]]) -> list[tuple[str, Ensemble]]:
        """Fits of settings that differ only in limits, loosest first: one whose limits bar no split of a fit under looser
        limits is that fit."""
        found: list[tuple[tuple, str, Ensemble]] = []
        for key, (name, params) in sorted(like, key=lambda kh: limits(kh[1][1])):
            own = limits(params)
            same = (m for other, _, m in found if all(a <= b for a, b in zip(other, own)) and unbarred(m, params))
            found.append((own, key, next(same, None) or self._fitted((name, params))))
        return [(key, m) for _, key, m in found]

    def models(self, settings: list[tuple[str, dict]], fold) -> list[Ensemble]:
        self.begin(fold)
        keys = [json.dumps(self.holder[json.dumps(s, sort_keys=True)], sort_keys=True) for s in settings]
        families: dict[str, list] = defaultdict(list)
        for key in dict.fromkeys(keys):
            if key not in self.done:
                name, params = json.loads(key)
                families[json.dumps([name, {a: v for a, v in params.items() if a not in LIMITS}], sort_keys=True)].append((key, (name, params)))
        with ThreadPoolExecutor(self.parallelism) as ex:
            for found in ex.map(self._family, families.values()):
                self.done.update(found)
        cuts: dict[tuple, Ensemble] = {}
        out = []
        for key, (name, params) in zip(keys, settings):
            whole = self.done[key]
            cut_at = (id(whole), *(params.get(a) for a in _held_axes(name, params)))
            if cut_at not in cuts:
                cuts[cut_at] = held(whole, name, params)
            out.append(cuts[cut_at])
        return out


def search_table(df: DataFrame, target: str = "log_amount", num=None, cat=None, n_splits: int = 5) -> tuple[DataFrame, list[int]]:
    """The search's one table (deal_id, test_fold, first_train_fold, label, features) and its usable folds."""
    num, cat = num or P.ML_NUMERIC, cat or P.ML_CATEGORICAL
    d = P.folds_expanding(df.where(F.col(target).isNotNull()).select(*dict.fromkeys(["deal_id", "year", target, *num, *cat])), n_splits)
    d = written(d.drop("_at"), "folds")
    usable = sorted(r[0] for r in d.select("test_fold").where("test_fold IS NOT NULL").distinct().collect())
    first = d.where(F.col("first_train_fold") <= min(usable, default=0))
    return prepared(d, first, num, cat, target, ["deal_id", "test_fold", "first_train_fold"]), usable


def fold_rows(table: DataFrame, n_splits: int = 5) -> DataFrame:
    """fold, n_train, n_test of a search table."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    return table.select(each, "test_fold", "first_train_fold").groupBy("fold").agg(
        F.count(F.when(F.col("first_train_fold") <= F.col("fold"), 1)).alias("n_train"),
        F.count(F.when(F.col("test_fold") == F.col("fold"), 1)).alias("n_test"))


def every_fold(settings: list[tuple[str, dict]], folds: list, fits: Fits, score: Callable) -> list[list[tuple]]:
    """Grid search: every setting is fitted on every fold's training rows and scored on all its test rows; none is dropped.
    Per fold what ``score(models, fold)`` gives for each setting."""
    out = []
    for fold in folds:
        out.append(score(fits.models(settings, fold), fold))
        sweep(fits.rows.sparkSession)
    return out


def tune_regression(df: DataFrame, target: str = "log_amount", num=None, cat=None, n_splits: int = 5,
                    grid: dict | None = None, parallelism: int = 8) -> tuple[DataFrame, DataFrame]:
    """M6: expanding-window grid search. For every setting RMSE(log) and MAPE (M7) over all folds; best = lowest MAPE (D3
    fixed: minimised). One prepared table with its fold columns is persisted. Returns (summary, best out-of-fold
    predictions)."""
    grid = grid or REG_GRID
    table, usable = search_table(df, target, num, cat, n_splits)
    kept, d = few_tasks(table)
    settings = [(name, p) for name, ps in grid.items() for p in ps]
    fits = Fits(settings, lambda i: d.where(F.col("first_train_fold") <= i).select("label", "features"), _regressor, parallelism)

    def error(label, prediction):
        y, p = np.exp(label), np.maximum(np.exp(prediction), 0.1)
        return np.abs(y - p) / np.maximum(y, 1.0) * 100

    models: dict[int, list[Ensemble]] = {}

    def score(found, i):
        models[i] = _bare(found)
        return [(r[0], r[1], r[4]) for r in paired_losses(d.where(F.col("test_fold") == i), found, None, error)]

    try:
        return _regression_summary(df, settings, every_fold(settings, usable, fits, score), models, d)
    finally:
        fits.end()
        kept.unpersist()


def _regression_summary(df, settings, by_fold, models, d) -> tuple[DataFrame, DataFrame]:
    found = [[sum(v) for v in zip(*of)] for of in zip(*by_fold)]  # n, absolute percentage and squared errors over the folds
    best = min(range(len(settings)), key=lambda k: found[k][1] / found[k][0])
    rows = [(name, json.dumps(params, sort_keys=True), (square / n) ** 0.5, loss / n, n, len(by_fold), k == best)
            for k, ((name, params), (n, loss, square)) in enumerate(zip(settings, found))]
    summary = df.sparkSession.createDataFrame(rows, "model string, params string, rmse_log double, mape double, n_oof long, folds_seen int, is_best boolean")
    preds = [scores(d.where(F.col("test_fold") == i), {i: ms[best]}, [("deal_id", "long"), ("label", "double")])
             .select("deal_id", F.col("setting").alias("fold"), "label", F.col("score").alias("prediction")) for i, ms in models.items()]
    return summary, reduce(DataFrame.unionByName, preds)


def tune_classification(df: DataFrame, target: str = "adaptive_target", num=None, cat=None, k: int = 5,
                        grid: dict | None = None, parallelism: int = 8) -> tuple[DataFrame, DataFrame]:
    """M8: stratified 70/30 split (M3), stratified k folds on the training part (M4), grid search by mean fold ROC-AUC (M9) with
    the squared error of the probability, refit of each family's best on the whole training part, held-out accuracy and
    AUC. Returns (summary, test predictions of the overall best)."""
    num, cat, grid = num or P.ML_NUMERIC, cat or P.ML_CATEGORICAL, grid or CLF_GRID
    s = P.split_stratified(df.where(F.col(target).isNotNull()).select(*dict.fromkeys(["deal_id", target, *num, *cat])), target)
    train = P.folds_stratified(s.where("is_test = 0").drop("_at"), target, k)
    d = train.select(*[c for c in s.columns if c != "_at"], "fold").unionByName(s.where("is_test = 1").drop("_at").withColumn("fold", F.lit(-1)))
    d = written(d.select(*dict.fromkeys(["deal_id", target, "fold", *num, *cat])), "classes")
    sweep(df.sparkSession)
    w = {r[0]: r["weight"] for r in P.class_weight(d.where("fold >= 0"), target).collect()}  # one number per class
    d = d.withColumn("weight", F.when(F.col(target) == 1, F.lit(w.get(1))).otherwise(F.lit(w.get(0))))
    table = prepared(d, d.where("fold >= 0"), num, cat, target, ["deal_id", "fold", "weight"])
    kept, d = few_tasks(table)
    settings = [(name, p) for name, ps in grid.items() for p in ps]

    def score(model, data, out="score"):
        drop = [c for c in ("rawPrediction", "probability") if c in data.columns]
        return model.transform(data.drop(*drop)).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability")

    fits = Fits(settings, lambda i: d.where(f"fold >= 0 and fold <> {i}").select("label", "weight", "features"), _classifier, parallelism)

    try:
        by_fold = every_fold(settings, list(range(k)), fits, lambda models, i: ranked(d.where(f"fold = {i}"), models))
        seen = [[v for v in of if v[0]] for of in zip(*by_fold)]
        auc = {j: sum(a) / len(a) for j, of in enumerate(seen) if (a := [v[2] for v in of if v[2] is not None])}
        chosen = {}
        for j, (name, _) in enumerate(settings):
            if j in auc and (name not in chosen or auc[j] > auc[chosen[name]]):
                chosen[name] = j
        fits.end()
        whole = d.where("fold >= 0").select("label", "weight", "features")
        with ThreadPoolExecutor(side_by_side(whole, parallelism)) as ex:
            refits = list(ex.map(lambda j: _classifier(*settings[j]).fit(whole), chosen.values()))
        final = {j: score(m, d.where("fold = -1")) for j, m in zip(chosen.values(), refits)}
        test = reduce(DataFrame.unionByName, [p.select(F.lit(j).alias("setting"), "label", "score", "prediction") for j, p in final.items()])
        hit = {r[0]: r[1] for r in test.groupBy("setting").agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).collect()}
        held = {r[0]: r[1] for r in P.roc_auc(test, "label", "score", ["setting"]).collect()}
        best = max(final, key=lambda j: held[j])
        n_oof = [sum(v[0] for v in of) for of in seen]
        rows = [(name, json.dumps(p, sort_keys=True), sum(v[1] for v in seen[j]) / n_oof[j], n_oof[j], len(by_fold), auc.get(j), hit.get(j), held.get(j), j == best)
                for j, (name, p) in enumerate(settings)]
        summary = df.sparkSession.createDataFrame(rows, "model string, params string, squared_error double, n_oof long, folds_seen int, cv_auc double, "
                                                        "accuracy double, roc_auc double, is_best boolean")
        return summary, final[best].select("deal_id", "label", "score", "prediction")
    finally:
        fits.end()
        kept.unpersist()


# ------------------------------------------------------------------ G5
CAUSAL_CONTROLS_NUM = ["roll_lag_mean_2", "roll_lag_mean_3", "roll_lag_std_2", "roll_lag_std_3", "sector_blend_loo",
                       "region_blend_loo"]
CAUSAL_CONTROLS_CAT = ["sector", "region", "deal_type"]


def dml_effect(df: DataFrame, outcome: str = "log_amount", treatment: str = "post_policy", k: int = 2,
               num=None, cat=None, seed: int = 42, trees: int = 100) -> DataFrame:
    """Partialling-out effect of a 0/1 treatment with random-forest nuisances,
    cross-fitted over ``k`` hash folds: residuals y~ = y - E[y|X], t~ = t - P[t|X]
    from out-of-fold predictions; theta = sum t~y~ / sum t~^2; heteroscedasticity-
    robust standard error; normal p-value and 95% interval; percent effect.
    Controls exclude the treatment and everything derived from the year (D6); rows
    with a missing outcome, treatment or control are left out."""
    num, cat = num or CAUSAL_CONTROLS_NUM, cat or CAUSAL_CONTROLS_CAT
    from .clean import complete_cases
    d = complete_cases(df, [outcome, treatment, *num, *cat]).select("deal_id", outcome, treatment, *num, *cat)
    d = d.withColumn("_fold", F.pmod(F.xxhash64("deal_id", F.lit(seed)), F.lit(k)).cast("int")).persist()

    def fold(i):
        tr, te = design(d.where(F.col("_fold") != i), [d.where(F.col("_fold") == i)], num, cat, outcome,
                        ["deal_id", treatment])
        tr = tr.select("deal_id", treatment, "label", "features").persist()
        trt = tr.withColumn("label", F.col(treatment).cast("double"))
        with ThreadPoolExecutor(2) as ex:  # outcome and treatment nuisances fit concurrently
            fy = ex.submit(RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees,
                                                 minInstancesPerNode=10, seed=seed).fit, tr)
            ft = ex.submit(RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees,
                                                  minInstancesPerNode=10, seed=seed).fit, trt)
            my, mt = fy.result(), ft.result()
        tr.unpersist()
        py = my.transform(te).select("deal_id", F.col("label").alias("y"), F.col("prediction").alias("y_hat"),
                                     F.col(treatment).cast("double").alias("t"))
        pt = mt.transform(te.withColumn("label", F.col(treatment).cast("double"))).select(
            "deal_id", vector_to_array("probability")[1].alias("t_hat"))
        return py.join(pt, "deal_id")

    with ThreadPoolExecutor(max(1, k)) as ex:
        parts = list(ex.map(fold, range(k)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    r = res.select((F.col("y") - F.col("y_hat")).alias("ry"), (F.col("t") - F.col("t_hat")).alias("rt"))
    out = residual_effect(r)  # one row, computed here while the prepared rows are still cached
    row = out.first()
    d.unpersist()
    return df.sparkSession.createDataFrame([row], out.schema)


def residual_effect(r: DataFrame) -> DataFrame:
    """G5 final stage on a residual table (ry, rt): one aggregation of the products that the estimate and the robust
    variance need, meat = S22 - 2 theta S31 + theta^2 S40."""
    t, y = F.col("rt"), F.col("ry")
    s = r.agg(F.sum(t * y).alias("s11"), F.sum(t * t).alias("s20"), F.sum(t * t * y * y).alias("s22"),
              F.sum(t * t * t * y).alias("s31"), F.sum(t * t * t * t).alias("s40"), F.count(F.lit(1)).alias("n"))
    theta = F.col("s11") / F.col("s20")
    v = s.select("n", theta.alias("theta"), (F.sqrt(F.greatest(F.col("s22") - 2 * theta * F.col("s31") + theta * theta * F.col("s40"), F.lit(0.0)))
                                             / F.col("s20")).alias("se"))
    th, se = F.col("theta"), F.col("se")
    return v.select(th.alias("effect_log"), se.alias("stderr"), (2 * (1 - _norm_cdf(F.abs(th / se)))).alias("p_value"),
                    (th - 1.959963984540054 * se).alias("ci_low"), (th + 1.959963984540054 * se).alias("ci_high"),
                    (F.expm1(th) * 100).alias("effect_pct"), "n")


def _norm_cdf(x):
    # standard normal CDF through erf (JVM-side): 0.5 * (1 + erf(x / sqrt 2)), erf via
    # Abramowitz-Stegun 7.1.26 (|error| < 1.5e-7)
    t = 1 / (1 + 0.3275911 * x / 2 ** 0.5)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-(x / 2 ** 0.5) ** 2)
    return 0.5 * (1 + erf)


# ------------------------------------------------------------------ M13
def refit_winner(summary: DataFrame, full: DataFrame):
    """The model and settings of the best row of ``tune_regression``'s summary, fitted on ``full``."""
    best = summary.where("is_best").first()
    return _regressor(best["model"], json.loads(best["params"])).fit(full)


def tree_weights(model) -> list[float]:
    """What each tree counts in the prediction: boosted trees are summed by weight, a forest's are averaged."""
    weights = list(model.treeWeights)
    forest = isinstance(model, (RandomForestRegressionModel, RandomForestClassificationModel))
    return [w / sum(weights) for w in weights] if forest else weights


def tree_tables(model, spark: SparkSession | None = None) -> list[Tree]:
    """Trees of a fitted ensemble with their covers (training weight by node) and gains, read back from the model's saved
    ``data`` folder: a bounded number of nodes. A classification forest's values are the shares of class 1, its nodes also
    have their class (``call``)."""
    import uuid
    from ..session import shared_dir
    ss = spark or SparkSession.getActiveSession()
    path = f"{shared_dir(ss)}/model-{uuid.uuid4().hex[:10]}"
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    nodes = ss.read.parquet(f"{path}/data").select(
        "treeID", node["rawCount"].alias("rows"), node["id"].alias("id"), node["prediction"].alias("value"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), node["split"]["leftCategoriesOrThreshold"].alias("thr"),
        node["split"]["numCategories"].alias("ncat"), node["impurityStats"].alias("stats"), node["gain"].alias("gain"))
    trees: dict[int, dict] = {}
    for n in nodes.collect():
        if n["left"] >= 0 and n["ncat"] != -1:
            raise ValueError("categorical splits are not supported")
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    classes = isinstance(model, RandomForestClassificationModel)
    out = []
    for tid, weight in enumerate(tree_weights(model)):
        by = [trees[tid][i] for i in range(len(trees[tid]))]
        out.append(Tree(weight, [n["left"] for n in by], [n["right"] for n in by], [n["feature"] for n in by],
                        [n["thr"][0] if n["left"] >= 0 else 0.0 for n in by],
                        [n["stats"][1] / sum(n["stats"]) if classes else n["value"] for n in by],
                        [sum(n["stats"]) if classes else n["stats"][0] for n in by], [n["gain"] for n in by],
                        [n["value"] for n in by] if classes else [], [n["rows"] for n in by]))
    return out


def ensemble(model, spark: SparkSession | None = None) -> Ensemble:
    return Ensemble(tree_tables(model, spark), isinstance(model, GBTClassificationModel))


def attributions(df: DataFrame, model, feature_names: list[str]) -> DataFrame:
    """Per-row Shapley values of a tree ensemble; base = its expectation by the trees' covers; sum(phi) + base =
    prediction. Output: deal_id, feature, phi, base (rows x features; for ranks use attribution_sums)."""
    credit, names = credits(tree_tables(model), len(feature_names)), list(feature_names)

    def fn(it):
        for pdf in it:
            n = len(pdf)
            phi, base = credit(np.stack(pdf["f"].to_numpy()) if n else np.zeros((0, len(names))))
            yield pd.DataFrame({"deal_id": np.repeat(pdf["deal_id"].to_numpy(), len(names)),
                                "feature": np.tile(np.array(names, dtype=object), n), "phi": phi.reshape(-1),
                                "base": np.full(n * len(names), base)})

    return df.select("deal_id", vector_to_array("features").alias("f")).mapInPandas(
        fn, "deal_id long, feature string, phi double, base double")


def attribution_sums(df: DataFrame, model, feature_names: list[str]) -> DataFrame:
    """M13 for rankings: one row per feature and partition with the sum of |phi|, the rows, and, if ``df`` has a
    prediction column, the largest |base + sum(phi) - prediction|."""
    credit, names = credits(tree_tables(model), len(feature_names)), list(feature_names)
    has = "prediction" in df.columns

    def fn(it):
        total, n, worst = np.zeros(len(names)), 0, 0.0
        for pdf in it:
            if len(pdf):
                phi, base = credit(np.stack(pdf["f"].to_numpy()))
                total += np.abs(phi).sum(0)
                n += len(pdf)
                if has:
                    worst = max(worst, float(np.abs(phi.sum(1) + base - pdf["p"].to_numpy()).max()))
        yield pd.DataFrame({"feature": names, "abs_phi": total, "n": n, "max_error": worst})

    p = F.col("prediction") if has else F.lit(None).cast("double")
    return df.select(vector_to_array("features").alias("f"), p.alias("p")).mapInPandas(
        fn, "feature string, abs_phi double, n long, max_error double")
