"""Inference and distribution operators on grouped sufficient statistics.

No design matrix is ever built: every model below is a closed form in per-group
counts, means and centred cross-products (``regr_sxx`` etc.), which aggregate
with map-side partial aggregation and shuffle one row per group. Tail
probabilities are computed on the small result rows (``functions.dist``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from .common import scalars
from .ordered import ROWS_PER_BLOCK, block_start, exact_quantiles, numbered, partition_of, written

LN2PI = math.log(2 * math.pi)


# ------------------------------------------------------------------ T1
def comoments(df: DataFrame, group: str, factors: list[str], x: str, y: str) -> DataFrame:
    """One aggregation by GROUPING SETS: n, means and centred sums of squares and products of x and y per (group, level) of
    each factor and, with factor NULL, per group. Partial results merge by the pairwise update of centred moments, so
    values far from 0 don't cancel. One row per level."""
    d = df.select(F.col(group).alias("_g"), *[F.col(f).cast("string").alias(f"_l{i}") for i, f in enumerate(factors)],
                  F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    names = [f"_l{i}" for i in range(len(factors))]
    g = d.groupingSets([["_g", c] for c in names] + [["_g"]], "_g", *names).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("xbar"), F.avg("_y").alias("ybar"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_syy("_y", "_x").alias("syy"),
        (F.min("_x") < F.max("_x")).alias("_varies"), F.grouping_id().alias("_id"))
    # merged means of a constant x may differ in the last bit: its sums are 0 by definition
    g = g.withColumns({c: F.when(F.col("_varies"), F.col(c)).otherwise(0.0) for c in ("sxx", "sxy")})
    factor, level, every = F.lit(None).cast("string"), F.lit(None).cast("string"), (1 << len(names)) - 1
    for i, f in enumerate(factors):
        mine = F.col("_id") == every - (1 << (len(names) - 1 - i))
        factor, level = F.when(mine, F.lit(f)).otherwise(factor), F.when(mine, F.col(names[i])).otherwise(level)
    return g.select(F.col("_g").alias(group), factor.alias("factor"), level.alias("level"), "n", "xbar", "ybar", "sxx", "sxy", "syy")


def interaction_fits(df: DataFrame, group: str, factors: list[str], x: str, y: str, min_rows: int, skip_prefix: str | None) -> DataFrame:
    """The co-moments of all levels beside what their (group, factor) fit needs: n_obs, k, ssr, sst, n_levels and the base
    level's moments (b_...). Windows over the table of levels share one exchange by group."""
    c = comoments(df, group, factors, x, y)
    fit, first = Window.partitionBy(group, "factor"), Window.partitionBy(group, "factor").orderBy("level")
    ssr = F.when(F.col("sxx") > 0, F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")).otherwise(F.col("syy"))
    c = c.withColumn("sst", F.max(F.when(F.col("factor").isNull(), F.col("syy"))).over(Window.partitionBy(group))).where("factor is not null")
    c = c.select("*", F.sum("n").over(fit).alias("n_obs"), F.sum(F.when(F.col("sxx") > 0, 2).otherwise(1)).over(fit).alias("k"),
                 F.sum(ssr).over(fit).alias("ssr"), F.count(F.lit(1)).over(fit).alias("n_levels"), F.first("level").over(first).alias("b_level"),
                 *[F.first(m).over(first).alias(f"b_{m}") for m in ("n", "xbar", "ybar", "sxx", "sxy")])
    c = c.where((F.col("n_obs") >= min_rows) & (F.col("n_levels") >= 2))
    return c.where(~F.col(group).startswith(skip_prefix)) if skip_prefix else c


def _fit_measures(group: str, x: str) -> list:
    n, k, ssr, sst = F.col("n_obs"), F.col("k"), F.col("ssr"), F.col("sst")
    llf = -n / 2 * (F.lit(LN2PI) + F.log(ssr / n) + 1)
    return [F.concat(F.lit(f"{x} * "), F.col("factor")).alias("interaction"),
            (1 - ssr / sst).alias("r2"), (1 - (ssr / sst) * (n - 1) / (n - k)).alias("r2_adj"),
            ((sst - ssr) / (k - 1) / (ssr / (n - k))).alias("f_stat"), (k - 1).alias("df_model"),
            (n - k).alias("df_resid"), n.alias("n_obs"), k.alias("k"),
            (-2 * llf + 2 * k).alias("aic"), (-2 * llf + k * F.log(n)).alias("bic")]


def ols_interaction(df: DataFrame, group: str, factors: list[str], x: str = "year", y: str = "log_amount",
                    min_rows: int = 50, skip_prefix: str | None = "Fora") -> DataFrame:
    """Per group and factor, y ~ x * C(factor) (treatment dummies, first level as base).
    The fully interacted model equals one simple regression per level, so
    SSR = sum_l (syy_l - sxy_l^2 / sxx_l) and the rank is sum_l (1 + [sxx_l > 0]).
    Groups with < ``min_rows`` rows, < 2 levels or a label starting with
    ``skip_prefix`` are skipped. Returns r2, r2_adj, aic, bic, n_obs, k, and the
    F statistic with its degrees of freedom, for all factors from one table of
    co-moments."""
    fits = interaction_fits(df, group, factors, x, y, min_rows, skip_prefix)
    return fits.where("level <=> b_level").select(group, *_fit_measures(group, x))


def ols_interaction_tests(df: DataFrame, group: str, factors: list[str], x: str = "year", y: str = "log_amount",
                          min_rows: int = 50, alpha: float = 0.1, skip_prefix: str | None = "Fora") -> DataFrame:
    """T1 (tests): F p-value and the number of coefficients with p < alpha in the
    treatment parametrisation (intercept, slope, per-level intercept and slope
    differences to the base level). Differences involving a level without slope
    variance (sxx = 0) are not estimable and are excluded."""
    j = interaction_fits(df, group, factors, x, y, min_rows, skip_prefix)
    dof = F.col("n_obs") - F.col("k")
    s2 = F.col("ssr") / dof
    slope, base = F.col("sxy") / F.col("sxx"), F.col("b_sxy") / F.col("b_sxx")
    a_l, a_0 = F.col("ybar") - slope * F.col("xbar"), F.col("b_ybar") - base * F.col("b_xbar")
    v_al, v_a0 = (s2 * (1 / F.col(f"{p}n") + F.col(f"{p}xbar") ** 2 / F.col(f"{p}sxx")) for p in ("", "b_"))
    v_bl, v_b0 = s2 / F.col("sxx"), s2 / F.col("b_sxx")
    is_base = F.col("level").eqNullSafe(F.col("b_level"))
    ok = (F.col("sxx") > 0) & (F.col("b_sxx") > 0)
    t_int = F.when(ok, F.when(is_base, a_0 / F.sqrt(v_a0)).otherwise((a_l - a_0) / F.sqrt(v_al + v_a0)))
    t_slope = F.when(ok, F.when(is_base, base / F.sqrt(v_b0)).otherwise((slope - base) / F.sqrt(v_bl + v_b0)))
    tests = j.withColumns({"p_int": dist.t_pvalue(t_int, dof), "p_slope": dist.t_pvalue(t_slope, dof)})
    hits = sum(F.coalesce((F.col(c) < alpha).cast("int"), F.lit(0)) for c in ("p_int", "p_slope"))
    fits = tests.withColumn("n_significant", F.sum(hits).over(Window.partitionBy(group, "factor"))).where("level <=> b_level") \
        .select(group, *_fit_measures(group, x), "n_significant")
    return fits.select(group, "interaction", "n_obs", dist.f_pvalue(F.col("f_stat"), F.col("df_model"), F.col("df_resid")).alias("f_pvalue"),
                       F.col("n_significant").cast("int").alias("n_significant"))


# ------------------------------------------------------------------ T2
def mediation_effects(df: DataFrame, group: str, x: str, m: str, y: str) -> DataFrame:
    """T2 (coefficients): per group, a (m ~ x), b and c' (y ~ x + m), c (y ~ x),
    ACME = a*b, ADE = c', total = c, proportion mediated; plus the t statistics
    of a, b, c', c and the residual degrees of freedom. Closed form from centred
    cross-products (one aggregation)."""
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.regr_sxx(F.col(y), F.col(x)).alias("sxx"), F.regr_sxx(F.col(y), F.col(m)).alias("smm"),
        F.regr_syy(F.col(y), F.col(x)).alias("syy"), F.regr_sxy(F.col(y), F.col(x)).alias("sxy"),
        F.regr_sxy(F.col(y), F.col(m)).alias("smy"), F.regr_sxy(F.col(m), F.col(x)).alias("sxm"),
        (F.min(x) < F.max(x)).alias("vx"), (F.min(m) < F.max(m)).alias("vm"), (F.min(y) < F.max(y)).alias("vy"))
    n, sxx, smm, syy, sxy, smy, sxm = (F.col(c) for c in ("n_obs", "sxx", "smm", "syy", "sxy", "smy", "sxm"))
    det = sxx * smm - sxm * sxm
    a = sxm / sxx
    c = sxy / sxx
    cp = (smm * sxy - sxm * smy) / det
    b = (sxx * smy - sxm * sxy) / det
    s2_a = (smm - a * sxm) / (n - 2)
    s2_c = (syy - c * sxy) / (n - 2)
    s2_y = (syy - cp * sxy - b * smy) / (n - 3)
    return g.select(
        group, F.lit(f"{x} -> {m} -> {y}").alias("model"), "n_obs", "vx", "vm", "vy",
        a.alias("a_coef"), b.alias("b_coef"), cp.alias("c_prime_coef"), c.alias("c_coef"),
        (a * b).alias("acme"), cp.alias("ade"), c.alias("total_effect"),
        F.when(c != 0, a * b / c).alias("prop_mediated"),
        (a / F.sqrt(s2_a / sxx)).alias("a_t"), (b / F.sqrt(s2_y * sxx / det)).alias("b_t"),
        (cp / F.sqrt(s2_y * smm / det)).alias("c_prime_t"), (c / F.sqrt(s2_c / sxx)).alias("c_t"))


def mediation(df: DataFrame, group: str, x: str, mediators: list[str], y: str, min_rows: int = 50,
              min_mediation_rows: int = 80, alpha: float = 0.1, skip_prefix: str | None = "Fora") -> DataFrame:
    """T2 (report): effects with p-values; skips groups with < min_rows rows, with
    n <= min_mediation_rows, or a constant x/m/y; drops rows with |ACME| < 0.001
    unless both paths are significant; keeps only significant mediations, or all
    when none is significant."""
    parts = [mediation_effects(df, group, x, mm, y) for mm in mediators]
    e = parts[0]
    for p in parts[1:]:
        e = e.unionByName(p)
    e = e.where((F.col("n_obs") >= min_rows) & (F.col("n_obs") > min_mediation_rows)
                & F.col("vx") & F.col("vm") & F.col("vy"))
    if skip_prefix:
        e = e.where(~F.col(group).startswith(skip_prefix))
    e = e.select("*", dist.t_pvalue(F.col("a_t"), F.col("n_obs") - 2).alias("a_pval"),
                 dist.t_pvalue(F.col("b_t"), F.col("n_obs") - 3).alias("b_pval"),
                 dist.t_pvalue(F.col("c_prime_t"), F.col("n_obs") - 3).alias("c_prime_pval"),
                 dist.t_pvalue(F.col("c_t"), F.col("n_obs") - 2).alias("c_pval"))
    e = e.withColumn("a_sig", F.col("a_pval") < alpha).withColumn("b_sig", F.col("b_pval") < alpha) \
         .withColumn("mediation_significant", F.col("a_sig") & F.col("b_sig"))
    e = e.where(~((F.abs("acme") < 0.001) & ~F.col("mediation_significant")))
    e = e.withColumn("_any", F.max(F.col("mediation_significant").cast("int")).over(Window.partitionBy()))
    e = e.where((F.col("_any") == 0) | F.col("mediation_significant"))
    return e.select(group, "model", "a_coef", "a_pval", "a_sig", "b_coef", "b_pval", "b_sig", "c_prime_coef",
                    "c_prime_pval", "c_coef", "c_pval", "acme", "ade", "total_effect", "prop_mediated",
                    "mediation_significant", "n_obs")


# ------------------------------------------------------------------ T3-T5
def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 F.var_samp(value).alias("var"))


def welch_ttest(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch two-sample t between the first and second level (sorted) of
    ``group``: t, Welch dof, Hedges g (pooled sd, small-sample corrected), mean
    difference and its standard error, n. (D4 fixed: the two samples are split by
    group.) More than two levels raise an error when the result is computed."""
    mo = group_moments(df, group, value)
    rank = F.row_number().over(Window.orderBy(group))
    r = mo.withColumn("r", rank).withColumn("r", F.when(F.col("r") > 2, F.raise_error(F.lit(
        f"welch_ttest needs two groups of {group}; use pairwise_groups for more")).cast("int")).otherwise(F.col("r")))
    # the two group rows side by side (pivot on the group's rank, no join)
    j = r.groupBy().pivot("r", [1, 2]).agg(
        F.first(group).alias("g"), F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("var").alias("var"))
    j = j.select(*[F.col(f"{i}_{c}").alias(f"{c if c != 'g' else group}{i}") for i in (1, 2)
                   for c in ("g", "n", "mean", "var")])
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "mean1", "mean2", "var1", "var2"))
    se = F.sqrt(v1 / n1 + v2 / n2)
    dof = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    sp = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    d = (m1 - m2) / sp
    g = d * (1 - 3 / (4 * (n1 + n2) - 9))
    return j.select(F.col(f"{group}1").alias("group_1"), F.col(f"{group}2").alias("group_2"),
                    (m1 - m2).alias("mean_diff"), se.alias("se"), ((m1 - m2) / se).alias("t"), dof.alias("dof"),
                    g.alias("hedges_g"), (n1 + n2).alias("n_obs"))


def welch_ttest_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """T3 (tests): two-sided p-value and the 95% interval of the mean difference."""
    w = welch_ttest(df, group, value)
    tq = dist.t_quantile(F.lit(0.975), F.col("dof"))
    return w.select("group_1", "group_2", "t", "dof", dist.t_pvalue(F.col("t"), F.col("dof")).alias("p_value"),
                    (F.col("mean_diff") - tq * F.col("se")).alias("ci_low"),
                    (F.col("mean_diff") + tq * F.col("se")).alias("ci_high"))


def welch_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """T4: Welch's one-way ANOVA (unequal variances) from per-group n, mean, var."""
    mo = group_moments(df, group, value).where("n >= 2 AND var > 0")
    w = F.col("n") / F.col("var")
    t = mo.select("*", w.alias("w"))
    sc = scalars(t.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("wsum"),
                       (F.sum(F.col("w") * F.col("mean"))).alias("wm")))
    j = t.withColumn("k", F.lit(sc["k"]).cast("long")).withColumn("wsum", F.lit(sc["wsum"]).cast("double")) \
        .withColumn("mu", F.lit(sc["wm"]).cast("double") / F.col("wsum"))
    s = j.groupBy("k", "wsum").agg(
        F.sum(F.col("w") * (F.col("mean") - F.col("mu")) ** 2).alias("A0"),
        F.sum((1 - F.col("w") / F.col("wsum")) ** 2 / (F.col("n") - 1)).alias("lam"))
    k = F.col("k")
    a = F.col("A0") / (k - 1)
    b = 1 + 2 * (k - 2) / (k * k - 1) * F.col("lam")
    return s.select((a / b).alias("f_stat"), (k - 1).cast("double").alias("df1"),
                    ((k * k - 1) / (3 * F.col("lam"))).alias("df2"), k.alias("n_groups"))


def welch_anova_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    w = welch_anova(df, group, value)
    return w.select("*", dist.f_pvalue(F.col("f_stat"), F.col("df1"), F.col("df2")).alias("p_value"))


def pairwise_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """T5: Welch t for every pair of groups (self theta-join of the per-group
    aggregate, one row per group: pairs of groups, never pairs of rows)."""
    mo = group_moments(df, group, value).where("n >= 2")
    a = mo.select(*[F.col(c).alias(f"{c}_a") for c in mo.columns])
    b = mo.select(*[F.col(c).alias(f"{c}_b") for c in mo.columns])
    j = a.join(b, F.col(f"{group}_a") < F.col(f"{group}_b"))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se = F.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / (F.col("n_a") - 1) + vb ** 2 / (F.col("n_b") - 1))
    return j.select(F.col(f"{group}_a").alias("group_a"), F.col(f"{group}_b").alias("group_b"),
                    (F.col("mean_b") - F.col("mean_a")).alias("mean_diff"),
                    ((F.col("mean_b") - F.col("mean_a")) / se).alias("t"), dof.alias("dof"))


def holm(p: DataFrame, value: str = "p_value", keys=("group_a", "group_b"), out: str = "p_holm", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds Holm's adjustment over all rows: sorted p times (m - rank + 1), running maximum, capped at 1. Ranks come from
    a prefix scan, the running maximum from blocks and the maxima of earlier blocks; NULL p-values stay NULL and don't count."""
    m = p.where(F.col(value).isNotNull()).count()
    d = numbered(p.where(F.col(value).isNotNull()), [], [value, *keys], "_at").withColumn("_blk", block_start(rows_per_block))
    d = d.withColumn("_s", F.least(F.lit(1.0), (F.lit(m) - F.col("_at")) * F.col(value)))
    earlier = Window.partitionBy(partition_of("_blk")).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    ahead = d.groupBy("_blk").agg(F.max("_s").alias("_top")).select("_blk", F.coalesce(F.max("_top").over(earlier), F.lit(0.0)).alias("_ahead"))
    here = F.max("_s").over(Window.partitionBy("_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    done = d.withColumn("_here", here).join(ahead, "_blk").withColumn(out, F.greatest("_here", "_ahead"))
    return done.select(*p.columns, out).unionByName(p.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def pairwise_groups_tests(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """T5 (tests): Welch p-value per pair and its Holm adjustment over all pairs."""
    p = pairwise_groups(df, group, value).withColumn("p_value", dist.t_pvalue(F.col("t"), F.col("dof")))
    return holm(p).withColumn("significant", F.col("p_holm") < alpha)


def games_howell(df: DataFrame, group: str, value: str) -> DataFrame:
    """T5 for unequal variances: every pair's difference against the studentized range of all k groups, q = |t| sqrt(2) with
    Welch's degrees of freedom; p is the range's upper tail, conf_low and conf_high aren't built. Holm's adjustment beside."""
    k = group_moments(df, group, value).where("n >= 2").count()
    p = pairwise_groups(df, group, value).withColumn("q", F.abs("t") * 2 ** 0.5) \
        .withColumn("p_value", dist.range_pvalue(F.col("q"), F.lit(k), F.col("dof")))
    return holm(p).select("group_a", "group_b", "mean_diff", "q", "dof", "p_value", "p_holm")


# ------------------------------------------------------------------ T6-T7
def box_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles (exact, linear) and Tukey whiskers (most extreme values inside
    the 1.5 IQR fences) per group."""
    q = exact_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = df.select(group, value).join(q, group)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"), F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"))


def outlier_tags(df: DataFrame, group: str, value: str, key: str = "deal_id") -> DataFrame:
    """Rows outside the Tukey fences of their group."""
    q = exact_quantiles(df, [group], value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    j = df.select(key, group, value).join(q, group)
    return j.where((F.col(value) < F.col("q1") - 1.5 * iqr) | (F.col(value) > F.col("q3") + 1.5 * iqr)) \
        .select(key, group, value)


# ------------------------------------------------------------------ T8-T10
def histogram(df: DataFrame, value: str, bins: int, group: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed); non-empty bins only."""
    keys = [group] if group else []
    mm = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    if keys:
        j = df.select(*keys, value).join(mm, keys)
    else:
        sc = scalars(mm)
        j = df.select(value, F.lit(sc["lo"]).cast("double").alias("lo"), F.lit(sc["hi"]).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    b = F.when(F.col("hi") > F.col("lo"), b).otherwise(F.lit(0))
    return j.groupBy(*keys, b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count")) \
        .select(*keys, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("edge"), "count")


def one_sample_t(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group mean, sd, n and t = mean / (sd / sqrt(n))."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("sd")) \
        .withColumn("t", F.col("mean") / (F.col("sd") / F.sqrt("n")))


def one_sample_t_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """T9 (tests): two-sided p-value of the one-sample t against 0."""
    t = one_sample_t(df, group, value)
    return t.withColumn("p_value", dist.t_pvalue(F.col("t"), F.col("n") - 1))


def bandwidths(df: DataFrame, group: str, value: str, rule: str = "group") -> DataFrame:
    """Per group n, sd, mn, mx and the kernel bandwidth bw by one of three rules.

    ``group``: 0.9 * spread * n^-1/5 with spread = min(sd, IQR / 1.34), or the sd if that is 0, or |first value| (here:
    |minimum|), or 1, so no group is left out; ``shared``: the mean of these over the groups, as joint ridgelines have
    it; ``scott``: sd * n^-1/5, with the same fallback. A group of one value has no sd and falls back too."""
    q = exact_quantiles(df, [group], value, {"_q1": 0.25, "_q3": 0.75})
    st = df.groupBy(group).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"),
                               F.min(value).alias("mn"), F.max(value).alias("mx")).where("n > 0").join(q, group)
    sd = F.coalesce("sd", F.lit(0.0))
    spread = sd if rule == "scott" else F.least(sd, (F.col("_q3") - F.col("_q1")) / 1.34)
    spread = F.when(spread > 0, spread).when(sd > 0, sd).when(F.col("mn") != 0, F.abs("mn")).otherwise(1.0)
    st = st.withColumn("bw", (1.0 if rule == "scott" else 0.9) * spread * F.pow(F.col("n"), -0.2)).drop("_q1", "_q3")
    if rule == "shared":
        st = st.withColumn("bw", F.lit(scalars(st.agg(F.avg("bw").alias("b")))["b"]).cast("double"))
    return st


def grouped_density(df: DataFrame, group: str, value: str, grid: int = 512, cut: float = 3.0, rule: str = "group") -> DataFrame:
    """Gaussian kernel density per group at ``grid`` points from min - cut*bw to max + cut*bw, bandwidth by ``rule`` (see
    bandwidths).

    Linear binning: a value's mass is split between the two grid points beside it, in proportion to its closeness, and
    summed per grid point before the shuffle. The masses of a group, an array of ``grid`` numbers whatever its rows, are
    convolved with the kernel by one fast Fourier transform. The rows are read once; all passes use a narrow copy."""
    base = written(df.select(group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()), "density")
    st = bandwidths(base, group, "_v", rule)
    st = written(st.withColumn("lo", F.col("mn") - cut * F.col("bw")).withColumn(
        "step", (F.col("mx") - F.col("mn") + 2 * cut * F.col("bw")) / (grid - 1)).select(group, "n", "bw", "lo", "step"), "density-groups")
    at = (F.col("_v") - F.col("lo")) / F.col("step")
    low = F.least(F.floor(at), F.lit(grid - 2))
    mass = base.join(st.select(group, "lo", "step"), group).select(group, low.cast("int").alias("i"), (at - low).alias("f")) \
        .groupBy(group, "i").agg(F.sum(1 - F.col("f")).alias("a"), F.sum("f").alias("b")) \
        .groupBy(group).agg(F.collect_list(F.struct("i", "a", "b")).alias("mass"))
    weights = mass.join(st, group).select(group, "n", "bw", "lo", "step", _convolved(F.col("mass"), F.col("step") / F.col("bw"), F.lit(grid)).alias("w"))
    return weights.select(group, "n", "bw", "lo", "step", F.posexplode("w").alias("grid_index", "weight")).select(
        group, "grid_index", (F.col("lo") + F.col("grid_index") * F.col("step")).alias("x"), "weight",
        (F.col("weight") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _convolved(mass: pd.Series, ratio: pd.Series, grid: pd.Series) -> pd.Series:
    """Per group: the masses at grid points convolved with exp(-(d * ratio)^2 / 2), one row per group."""
    out = []
    for cells, r, n in zip(mass, ratio, grid):
        c = np.zeros(n)
        for x in cells:
            c[x["i"]] += x["a"]
            c[x["i"] + 1] += x["b"]
        size = 1 << (2 * n - 1).bit_length()
        d = np.arange(n) * r
        kernel = np.zeros(size)
        kernel[:n] = np.exp(-0.5 * d * d)
        kernel[size - n + 1:] = kernel[1:n][::-1]
        out.append(np.maximum(np.fft.irfft(np.fft.rfft(c, size) * np.fft.rfft(kernel), size)[:n], 0.0))
    return pd.Series(out)
