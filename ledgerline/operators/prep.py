"""Feature preparation, splits/folds and evaluation metrics.

Fitted statistics (medians, means, level lists) are small per-column values; they
are computed by distributed aggregations and applied as column expressions.
Ranks inside a class or over the whole table come from a prefix scan over range
partitions (ordered.numbered), never from a single-partition window over rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scalars
from .ordered import before, block_start, exact_quantiles, in_order, numbered, written

# Model inputs. The rolling statistics are the lagged ones (previous deals only) and
# the group-mean blends leave the row out: the source's versions contain the target
# amount itself.
ML_NUMERIC = ["year", "roll_lag_mean_2", "roll_lag_mean_3", "roll_lag_std_2", "roll_lag_std_3", "policy_cumulative",
              "policy_interaction", "sector_blend_loo", "region_blend_loo", "phase_1", "phase_2", "phase_3",
              "sector_year_int", "region_policy_int"]
ML_CATEGORICAL = ["sector", "region", "deal_type", "phase", "post_policy"]


# ------------------------------------------------------------------ M1/M2
def fit_numeric(df: DataFrame, cols: list[str]) -> dict:
    """Exact medians (imputation) then mean / population std of the imputed column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "col", "x")
    med = {r["col"]: r["m"] for r in exact_quantiles(long, ["col"], "x", {"m": 0.5}).collect()}
    imp = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c))).alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    row = imp.agg(*aggs).first()
    return {c: (med.get(c), row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}


def fit_levels(df: DataFrame, cols: list[str], missing: str = "Missing", most: int = 1000) -> dict:
    """Sorted distinct levels per categorical column (NULL -> ``missing``). Columns with more than ``most`` levels are
    an error: encode those by a join (reports.level_table) instead of one expression per level."""
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in cols]).unpivot(
        [], cols, "col", "v").distinct()
    kept = long.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy("v"))).where(F.col("r") <= most + 1)
    out: dict[str, list] = {c: [] for c in cols}
    for r in kept.select("col", "v").collect():
        out[r["col"]].append(r["v"])
    wide = [c for c, v in out.items() if len(v) > most]
    if wide:
        raise ValueError(f"more than {most} levels in {wide}; encode by a join with reports.level_table")
    return {c: sorted(v) for c, v in out.items()}


def scaled(c: str, stats: tuple) -> Column:
    med, mean, std = stats
    x = F.coalesce(F.col(c).cast("double"), F.lit(med))
    return ((x - F.lit(mean)) / F.lit(std if std else 1.0)).alias(c)


def prep_linear(df: DataFrame, num: dict, levels: dict, keep: list[str], missing: str = "Missing") -> DataFrame:
    """M1: median impute + standardise; constant fill + one-hot (all levels, an
    unseen level gives all zeros)."""
    cols = [scaled(c, s) for c, s in num.items()]
    for c, lv in levels.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        cols += [(v == F.lit(x)).cast("int").alias(f"{c}={x}") for x in lv]
    return df.select(*keep, *cols)


def prep_tree(df: DataFrame, num: dict, levels: dict, keep: list[str], missing: str = "Missing") -> DataFrame:
    """M2: median impute + standardise; ordinal codes in sorted level order, unseen
    levels -> -1."""
    cols = [scaled(c, s) for c, s in num.items()]
    for c, lv in levels.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        e = F.lit(-1)
        for i, x in reversed(list(enumerate(lv))):
            e = F.when(v == F.lit(x), F.lit(i)).otherwise(e)
        cols.append(e.cast("int").alias(f"{c}_ord"))
    return df.select(*keep, *cols)


# ------------------------------------------------------------------ ranks, M3-M5
def rank_within(df: DataFrame, part: list[str], order: str, out: str = "rank0") -> DataFrame:
    """0-based rank of ``order`` inside each ``part`` group (pass a unique key, or one whose ties don't matter)."""
    return numbered(df, part, [order], out)


def hash_order(key: str, seed: int = 42) -> Column:
    """Deterministic pseudo-random order of a key: the digest of key and seed, which SQL engines share."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)).cast("binary"))


def split_stratified(df: DataFrame, label: str, key: str = "deal_id", test_frac: float = 0.3,
                     seed: int = 42) -> DataFrame:
    """M3: adds ``is_test``: in each class, the round(test_frac * n_c) rows first in
    hash order form the test set (exact per-class sizes, deterministic)."""
    d = df.withColumn("_h", hash_order(key, seed))
    r = rank_within(d, [label], "_h", "_r")
    n = r.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return r.join(n, label).withColumn("is_test", (F.col("_r") < F.round(F.col("_n") * test_frac)).cast("int")) \
        .drop("_h", "_r", "_n", "_at")


def folds_stratified(df: DataFrame, label: str, k: int = 5, key: str = "deal_id", seed: int = 42) -> DataFrame:
    """M4: ``fold`` = class-wise hash rank mod k (class proportions kept per fold)."""
    d = df.withColumn("_h", hash_order(key, seed + 1))
    return rank_within(d, [label], "_h", "_r").withColumn("fold", (F.col("_r") % k).cast("int")).drop("_h", "_r")


def row_index(df: DataFrame, order=("year", "deal_id"), out: str = "position") -> DataFrame:
    """0-based global position in (year, key) order."""
    return numbered(df, [], list(order), out)


def folds_expanding(df: DataFrame, n_splits: int = 5, min_train: int = 20, order=("year", "deal_id")) -> DataFrame:
    """M5: expanding-window folds on time order (test size n // (n_splits + 1)).
    Adds ``position``, ``test_fold`` (fold whose test block holds the row, NULL if
    none) and ``first_train_fold`` (first fold whose training window holds it).
    Folds whose training window is shorter than ``min_train`` are marked unusable
    via ``first_train_fold`` / ``test_fold`` staying within usable folds only."""
    d = row_index(df, order, "position")
    n = scalars(d.agg(F.count(F.lit(1)).alias("n")))["n"]
    j = d.withColumn("_n", F.lit(n).cast("long"))
    ts = F.floor(F.col("_n") / (n_splits + 1))
    # fold i test block = [n - (n_splits - i) * ts, n - (n_splits - i - 1) * ts)
    start0 = F.col("_n") - n_splits * ts
    rel = F.col("position") - start0
    test_fold = F.when(rel >= 0, F.floor(rel / ts)).cast("int")
    usable_from = F.greatest(F.ceil((F.lit(min_train) - start0) / ts), F.lit(0))  # first fold with train >= min
    first_train = F.greatest(F.when(rel < 0, F.lit(0)).otherwise(test_fold + 1), usable_from).cast("int")
    return j.select(*d.columns, F.when(test_fold >= usable_from, test_fold).alias("test_fold"),
                    F.when(first_train < n_splits, first_train).alias("first_train_fold"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return c.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


# ------------------------------------------------------------------ metrics
def regression_metrics(pred: DataFrame, y_log: str, p_log: str, group: list[str] | None = None) -> DataFrame:
    """M7: RMSE on the log scale and MAPE on the original scale with predictions
    floored at 0.1 and the denominator max(y, 1)."""
    y, p = F.exp(F.col(y_log)), F.greatest(F.exp(F.col(p_log)), F.lit(0.1))
    return pred.groupBy(*(group or [])).agg(
        F.sqrt(F.avg((F.col(y_log) - F.col(p_log)) ** 2)).alias("rmse_log"),
        (F.avg(F.abs(y - p) / F.greatest(y, F.lit(1.0))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"))


def score_groups(pred: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Per distinct score (of each group of ``by``): positives and negatives (small: one row per score)."""
    return pred.groupBy(*(by or []), F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def _desc_prefix(sg: DataFrame, rows_per_block: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Exclusive prefix sums of pos/neg over descending score (inside each group of ``by``): inside blocks, and over the
    blocks' totals; a group starts at the sums of its first row."""
    by = by or []
    d = in_order(written(sg, "scores"), [*by, F.desc("score")]).withColumn("_blk", block_start(rows_per_block) if rows_per_block else block_start())
    offs = before(d.groupBy("_blk").agg(F.sum("pos").alias("_po"), F.sum("neg").alias("_no")), ["_po", "_no"])
    wl = Window.partitionBy("_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    loc = d.select("*", F.coalesce(F.sum("pos").over(wl), F.lit(0)).alias("_pl"),
                   F.coalesce(F.sum("neg").over(wl), F.lit(0)).alias("_nl"))
    out = loc.join(offs, "_blk").select(*by, "score", "pos", "neg", (F.col("_po") + F.col("_pl")).alias("pos_above"),
                                        (F.col("_no") + F.col("_nl")).alias("neg_above"))
    if not by:
        return out
    start = out.groupBy(*by).agg(F.min("pos_above").alias("_p0"), F.min("neg_above").alias("_n0"))
    return out.join(start, by).select(*by, "score", "pos", "neg", (F.col("pos_above") - F.col("_p0")).alias("pos_above"),
                                      (F.col("neg_above") - F.col("_n0")).alias("neg_above"))


def roc_auc(pred: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """M9: rank AUC with ties counted half: sum over score groups of
    pos * (neg below + neg_same / 2) / (P * N), of the table or of each group of ``by``.
    Per-score aggregation first, then prefix sums of negatives; no row-level sort,
    totals in the same aggregation. NULL if a class is empty."""
    p = _desc_prefix(score_groups(pred, label, score, by), by=by)
    neg = F.sum("neg")
    # sum of pos * (N - neg_above - neg / 2), with N known only at the end
    above = F.sum(F.col("pos") * (F.col("neg_above") + F.col("neg") / 2))
    return p.groupBy(*(by or [])).agg(((F.sum("pos") * neg - above) / F.nullif(F.sum("pos") * neg, F.lit(0))).alias("auc"))


def accuracy(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    """M9: share of correct predictions."""
    return pred.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


CAL_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]


def calibration_curve(pred: DataFrame, label: str, score: str, n_bins: int = 10) -> DataFrame:
    """Uniform bins on [0, 1]; bin = number of inner edges strictly below the
    score (so 0.1 is in the first bin and 1.0 in the last); empty bins absent."""
    edges = [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    b = sum((F.col(score) > F.lit(e)).cast("int") for e in edges)
    return pred.groupBy(b.alias("bin")).agg(F.avg(score).alias("prob_pred"),
                                            F.avg(F.col(label).cast("double")).alias("prob_true"),
                                            F.count(F.lit(1)).alias("n"))


def pr_curve(pred: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score threshold (score >= t)."""
    groups = score_groups(pred, label, score)
    P_ = scalars(groups.agg(F.sum("pos").alias("P")))["P"]
    p = _desc_prefix(groups)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    return p.withColumn("P", F.lit(P_).cast("long")).select(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"), (tp / F.col("P")).alias("recall"))
