"""Inference and distribution queries. Tail probabilities (t, F) are reported by companion ``*_tests``
queries; their oracles integrate the densities numerically in SQL, another way than the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PRESET_A, PRESET_B
from ..operators import inference as I
from ..operators import reports as R
from ..operators.clean import cap_outliers, clean_rows_r
from ..operators.features import features
from ..sources.deals import deals
from . import sql as Q
from .registry import register

PA, PB = PRESET_A, PRESET_B


def feat(spark, sf):
    return features(spark, sf, PA)


def _r(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def _simpson(f: str, end: str, n: int) -> str:
    """Simpson's rule for the expression ``f`` of ``u`` over [0, end] with n (even) panels."""
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    body = f.replace("[u]", f"(({end}) * i / {n}.0)")
    return f"(({end}) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * {body})))"


def _t_p(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t: one minus the mass between -t and t, with t = sqrt(dof) tan(u)."""
    c = f"exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(pi())"
    return f"greatest(0.0, 1 - 2 * {c} * {_simpson(f'power(cos([u]), ({dof}) - 1)', f'atan(abs({t}) / sqrt({dof}))', 2000)})"


def _f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail of F: the incomplete beta integral up to x = d2 / (d2 + d1 f), with v = x exp(-u / a)."""
    a, b, x = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x})) / {a}"
    return f"{front} * {_simpson(f'exp(-[u]) * power(1 - {x} * exp(-[u] / {a}), {b} - 1)', '60.0', 6000)}"


def _t_q975(dof: str) -> str:
    """The 0.975 quantile of Student's t by its expansion in 1 / dof (four terms; for the large dof here)."""
    z = 1.959963984540054
    terms = [z, (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384]
    return "(" + " + ".join(f"{v!r} / power({dof}, {k})" for k, v in enumerate(terms)) + ")"


def _ols_sql(z: str) -> str:
    return f"""SELECT phase, 'year * {z}' AS interaction, 1 - ssr / sst AS r2,
       1 - (ssr / sst) * (n_obs - 1) / (n_obs - k) AS r2_adj,
       ((sst - ssr) / (k - 1)) / (ssr / (n_obs - k)) AS f_stat, k - 1 AS df_model, n_obs - k AS df_resid, n_obs, k,
       -2 * (-n_obs / 2.0 * (ln(2 * pi()) + ln(ssr / n_obs) + 1)) + 2 * k AS aic,
       -2 * (-n_obs / 2.0 * (ln(2 * pi()) + ln(ssr / n_obs) + 1)) + k * ln(n_obs) AS bic
FROM (SELECT l.phase, CAST(sum(l.n) AS BIGINT) AS n_obs, count(*) AS n_levels,
        sum(CASE WHEN sxx > 0 THEN syy - sxy * sxy / sxx ELSE syy END) AS ssr,
        CAST(sum(CASE WHEN sxx > 0 THEN 2 ELSE 1 END) AS BIGINT) AS k, max(t.sst) AS sst
      FROM (SELECT phase, {z}, count(*) AS n, regr_sxx(log_amount, year) AS sxx, regr_sxy(log_amount, year) AS sxy,
                   regr_syy(log_amount, year) AS syy FROM tagged GROUP BY 1, 2) l
      JOIN (SELECT phase, regr_syy(log_amount, year) AS sst FROM tagged GROUP BY 1) t ON t.phase = l.phase
      GROUP BY l.phase)
WHERE n_obs >= 50 AND n_levels >= 2 AND NOT starts_with(phase, 'Fora')"""


def _round_sql(inner: str, cols: dict[str, int]) -> str:
    sel = ", ".join(f"round({c}, {d}) AS {c}" if d is not None else c for c, d in cols.items())
    return f"SELECT {sel} FROM ({inner})"


_OLS_COLS = {"phase": None, "interaction": None, "r2": 6, "r2_adj": 6, "f_stat": 4, "df_model": None,
             "df_resid": None, "n_obs": None, "k": None, "aic": 4, "bic": 4}


@register("ols_interaction", Q.with_tagged(_round_sql(
    _ols_sql("sector") + " UNION ALL " + _ols_sql("region"), _OLS_COLS)))
def q_ols_interaction(spark, sf):
    """Per phase, log amount ~ year * C(sector) and * C(region) as grouped
    sufficient statistics (fit measures)."""
    f = feat(spark, sf)
    return I.ols_interaction(f, "phase", ["sector", "region"]).select(*[F.round(c, d).alias(c) if d else F.col(c) for c, d in _OLS_COLS.items()])


def _ols_tests_sql(z: str) -> str:
    return f"""SELECT fit.phase, interaction, fit.n_obs, round({_f_p('f_stat', 'df_model', 'df_resid')}, 6) AS f_pvalue,
       CAST(coalesce(sig, 0) AS INT) AS n_significant
FROM ({_ols_sql(z)}) fit LEFT JOIN (
  SELECT phase, sum(CAST(p < 0.1 AS INT)) AS sig FROM (
    SELECT phase, {_t_p('t', 'dof')} AS p FROM (
      SELECT c.phase, c.dof, unnest([t1, t2]) AS t FROM (
        SELECT l.phase, tot.dof,
          CASE WHEN l.lv = b.lv THEN b.a / sqrt(s2 * b.va) ELSE (l.a - b.a) / sqrt(s2 * (l.va + b.va)) END AS t1,
          CASE WHEN l.lv = b.lv THEN b.b / sqrt(s2 / b.sxx) ELSE (l.b - b.b) / sqrt(s2 / l.sxx + s2 / b.sxx) END AS t2
        FROM lev_{z} l JOIN (SELECT phase, arg_min(lv, lv) AS lv, arg_min(a, lv) AS a, arg_min(b, lv) AS b, arg_min(va, lv) AS va, arg_min(sxx, lv) AS sxx
                             FROM lev_{z} GROUP BY phase) b ON b.phase = l.phase
        JOIN (SELECT phase, sum(n) - sum(CASE WHEN sxx > 0 THEN 2 ELSE 1 END) AS dof,
                     sum(CASE WHEN sxx > 0 THEN syy - sxy * sxy / sxx ELSE syy END) / (sum(n) - sum(CASE WHEN sxx > 0 THEN 2 ELSE 1 END)) AS s2
              FROM lev_{z} GROUP BY phase) tot ON tot.phase = l.phase
        WHERE l.sxx > 0 AND b.sxx > 0) c)) GROUP BY phase) q ON q.phase = fit.phase"""


def _levels(z: str) -> str:
    return f"""lev_{z} AS (SELECT *, sxy / sxx AS b, ybar - sxy / sxx * xbar AS a, 1.0 / n + xbar * xbar / sxx AS va FROM
  (SELECT phase, {z} AS lv, count(*) AS n, avg(year) AS xbar, avg(log_amount) AS ybar, regr_sxx(log_amount, year) AS sxx,
          regr_sxy(log_amount, year) AS sxy, regr_syy(log_amount, year) AS syy FROM tagged GROUP BY 1, 2))"""


@register("ols_interaction_tests", Q.with_tagged(_ols_tests_sql("sector") + " UNION ALL " + _ols_tests_sql("region"), PA,
                                                 _levels("sector") + ",\n" + _levels("region")))
def q_ols_interaction_tests(spark, sf):
    """T1 (tests): F p-value and count of coefficients with p < 0.1."""
    return _r(I.ols_interaction_tests(feat(spark, sf), "phase", ["sector", "region"]))


@register("rank_models", Q.with_tagged(f"""
SELECT phase, interaction, r2, CAST(row_number() OVER (ORDER BY r2 DESC, phase, interaction) AS INT) AS "rank"
FROM ({_round_sql(_ols_sql("sector") + " UNION ALL " + _ols_sql("region"), _OLS_COLS)})"""))
def q_rank_models(spark, sf):
    """Interaction fits ordered by R^2 (descending)."""
    from pyspark.sql import Window
    o = I.ols_interaction(feat(spark, sf), "phase", ["sector", "region"])
    o = o.select("phase", "interaction", F.round("r2", 6).alias("r2"))
    return o.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r2"), "phase", "interaction")).cast("int"))


@register("best_model", Q.with_tagged(f"""
SELECT arg_max(phase || ' / ' || interaction, r2) AS best, max(r2) AS r2
FROM ({_round_sql(_ols_sql("sector") + " UNION ALL " + _ols_sql("region"), _OLS_COLS)})"""))
def q_best_model(spark, sf):
    """Arg-max of R^2 over the fits (max_by)."""
    o = I.ols_interaction(feat(spark, sf), "phase", ["sector", "region"])
    o = o.select(F.concat_ws(" / ", "phase", "interaction").alias("label"), F.round("r2", 6).alias("r2"))
    return o.agg(F.max_by("label", "r2").alias("best"), F.max("r2").alias("r2"))


def _med_sql(m: str) -> str:
    return f"""SELECT phase, 'year -> {m} -> log_amount' AS model, n_obs, a, b, cp, c, sxx, smm, syy, sxy, smy, sxm, det
FROM (SELECT phase, count(*) AS n_obs, regr_sxx(log_amount, year) AS sxx, regr_sxx(log_amount, {m}) AS smm,
        regr_syy(log_amount, year) AS syy, regr_sxy(log_amount, year) AS sxy, regr_sxy(log_amount, {m}) AS smy,
        regr_sxy({m}, year) AS sxm,
        regr_sxy({m}, year) / regr_sxx(log_amount, year) AS a, regr_sxy(log_amount, year) / regr_sxx(log_amount, year) AS c,
        regr_sxx(log_amount, year) * regr_sxx(log_amount, {m}) - regr_sxy({m}, year) * regr_sxy({m}, year) AS det,
        (regr_sxx(log_amount, {m}) * regr_sxy(log_amount, year) - regr_sxy({m}, year) * regr_sxy(log_amount, {m}))
          / (regr_sxx(log_amount, year) * regr_sxx(log_amount, {m}) - regr_sxy({m}, year) * regr_sxy({m}, year)) AS cp,
        (regr_sxx(log_amount, year) * regr_sxy(log_amount, {m}) - regr_sxy({m}, year) * regr_sxy(log_amount, year))
          / (regr_sxx(log_amount, year) * regr_sxx(log_amount, {m}) - regr_sxy({m}, year) * regr_sxy({m}, year)) AS b
      FROM feat GROUP BY phase)"""


_MED_COLS = ["a_coef", "b_coef", "c_prime_coef", "c_coef", "acme", "ade", "total_effect", "prop_mediated",
             "a_t", "b_t", "c_prime_t", "c_t"]


@register("mediation_effects", Q.with_features(f"""
SELECT phase, model, n_obs, round(a, 6) AS a_coef, round(b, 6) AS b_coef, round(cp, 6) AS c_prime_coef,
  round(c, 6) AS c_coef, round(a * b, 6) AS acme, round(cp, 6) AS ade, round(c, 6) AS total_effect,
  round(CASE WHEN c <> 0 THEN a * b / c END, 6) AS prop_mediated,
  round(a / sqrt(((smm - a * sxm) / (n_obs - 2)) / sxx), 4) AS a_t,
  round(b / sqrt(((syy - cp * sxy - b * smy) / (n_obs - 3)) * sxx / det), 4) AS b_t,
  round(cp / sqrt(((syy - cp * sxy - b * smy) / (n_obs - 3)) * smm / det), 4) AS c_prime_t,
  round(c / sqrt(((syy - c * sxy) / (n_obs - 2)) / sxx), 4) AS c_t
FROM ({_med_sql('sector_code')} UNION ALL {_med_sql('region_code')})"""))
def q_mediation_effects(spark, sf):
    """T2 (coefficients): year -> sector/region code -> log amount per phase."""
    f = feat(spark, sf)
    e = I.mediation_effects(f, "phase", "year", "sector_code", "log_amount").unionByName(
        I.mediation_effects(f, "phase", "year", "region_code", "log_amount"))
    return e.select("phase", "model", "n_obs",
                    *[F.round(c, 4 if c.endswith("_t") else 6).alias(c) for c in _MED_COLS])


_MEDIATORS = ["sector_code", "region_code", "roll_mean_3", "policy_cumulative"]


def _mediation_sql() -> str:
    rows = " UNION ALL ".join(_med_sql(m) for m in _MEDIATORS)
    stats = f"""SELECT *, a / sqrt(((smm - a * sxm) / (n_obs - 2)) / sxx) AS a_t,
  b / sqrt(((syy - cp * sxy - b * smy) / (n_obs - 3)) * sxx / det) AS b_t,
  cp / sqrt(((syy - cp * sxy - b * smy) / (n_obs - 3)) * smm / det) AS cp_t,
  c / sqrt(((syy - c * sxy) / (n_obs - 2)) / sxx) AS c_t
FROM ({rows}) WHERE n_obs >= {PA.min_phase_rows} AND n_obs > {PA.min_mediation_rows} AND NOT starts_with(phase, 'Fora')"""
    tests = f"""SELECT *, {_t_p('a_t', 'n_obs - 2')} AS a_p, {_t_p('b_t', 'n_obs - 3')} AS b_p, {_t_p('cp_t', 'n_obs - 3')} AS cp_p,
  {_t_p('c_t', 'n_obs - 2')} AS c_p FROM ({stats})"""
    flags = f"SELECT *, a_p < 0.1 AS a_sig, b_p < 0.1 AS b_sig, a_p < 0.1 AND b_p < 0.1 AS sig FROM ({tests})"
    kept = f"SELECT *, max(CAST(sig AS INT)) OVER () AS any_sig FROM ({flags}) WHERE NOT (abs(a * b) < 0.001 AND NOT sig)"
    return f"""SELECT phase, model, round(a, 6) AS a_coef, round(a_p, 6) AS a_pval, a_sig, round(b, 6) AS b_coef, round(b_p, 6) AS b_pval, b_sig,
  round(cp, 6) AS c_prime_coef, round(cp_p, 6) AS c_prime_pval, round(c, 6) AS c_coef, round(c_p, 6) AS c_pval, round(a * b, 6) AS acme,
  round(cp, 6) AS ade, round(c, 6) AS total_effect, round(CASE WHEN c <> 0 THEN a * b / c END, 6) AS prop_mediated,
  sig AS mediation_significant, n_obs FROM ({kept}) WHERE any_sig = 0 OR sig"""


@register("mediation", Q.with_features(_mediation_sql()))
def q_mediation(spark, sf):
    """T2 (report): effects, p-values, significance filter, over codes, the rolling mean and the cumulative count as
    mediators."""
    return _r(I.mediation(feat(spark, sf), "phase", "year", _MEDIATORS, "log_amount", PA.min_phase_rows, PA.min_mediation_rows))


def _welch_sql(col: str, label: str) -> str:
    return f"""SELECT '{label}' AS test, g1 AS group_1, g2 AS group_2, round(m1 - m2, 6) AS mean_diff,
  round(sqrt(v1 / n1 + v2 / n2), 6) AS se, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 6) AS dof,
  round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3 / (4 * (n1 + n2) - 9.0)), 6) AS hedges_g,
  n1 + n2 AS n_obs
FROM (SELECT min(g) AS g1, max(g) AS g2, arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(m, g) AS m1,
             arg_max(m, g) AS m2, arg_min(v, g) AS v1, arg_max(v, g) AS v2
      FROM (SELECT {col} AS g, count(amount) AS n, avg(amount) AS m, var_samp(amount) AS v FROM capped GROUP BY 1))"""


_CAPPED = "capped AS (SELECT *, CASE WHEN lower(trim(bri)) IN ('1', 'bri', 'y', 'yes', 'sim', 'true') THEN 'BRI' ELSE 'Others' END AS bri_group FROM tagged WHERE amount <= 300000)"


def _capped(spark, sf):
    from ..functions.scalar import is_bri
    return cap_outliers(feat(spark, sf), PA.amount_cap).withColumn("bri_group", is_bri("bri"))


@register("welch_ttest", Q.with_tagged(
    _welch_sql("deal_type", "deal_type") + " UNION ALL " + _welch_sql("bri_group", "bri"), PA, _CAPPED))
def q_welch_ttest(spark, sf):
    """Welch t, dof and Hedges g for deal type and BRI groups (amount <= cap)."""
    c = _capped(spark, sf)
    a = I.welch_ttest(c, "deal_type", "amount").withColumn("test", F.lit("deal_type"))
    b = I.welch_ttest(c, "bri_group", "amount").withColumn("test", F.lit("bri"))
    return _r(a.unionByName(b))


def _welch_tests_sql(col: str) -> str:
    return f"""SELECT group_1, group_2, round(t, 6) AS t, round(dof, 6) AS dof, round({_t_p('t', 'dof')}, 6) AS p_value,
  round(d - {_t_q975('dof')} * se, 4) AS ci_low, round(d + {_t_q975('dof')} * se, 4) AS ci_high
FROM (SELECT group_1, group_2, m1 - m2 AS d, sqrt(v1 / n1 + v2 / n2) AS se, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
             power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS dof
      FROM (SELECT min(g) AS group_1, max(g) AS group_2, arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(m, g) AS m1, arg_max(m, g) AS m2,
                   arg_min(v, g) AS v1, arg_max(v, g) AS v2
            FROM (SELECT {col} AS g, count(amount) AS n, avg(amount) AS m, var_samp(amount) AS v FROM capped GROUP BY 1)))"""


@register("welch_ttest_tests", Q.with_tagged(_welch_tests_sql("deal_type") + " UNION ALL " + _welch_tests_sql("bri_group"), PA, _CAPPED))
def q_welch_ttest_tests(spark, sf):
    """T3 (tests): p-value and 95% interval of the mean difference."""
    c = _capped(spark, sf)
    t = I.welch_ttest_tests(c, "deal_type", "amount").unionByName(I.welch_ttest_tests(c, "bri_group", "amount"))
    return _r(t, skip=("ci_low", "ci_high")).withColumns({k: F.round(k, 4) for k in ("ci_low", "ci_high")})


@register("group_means_bri", Q.with_tagged(
    "SELECT bri_group, round(avg(amount), 6) AS mean, count(*) AS n FROM capped GROUP BY 1", PA, _CAPPED))
def q_group_means_bri(spark, sf):
    """A11 on the BRI groups (amount <= cap)."""
    return R.group_means(_capped(spark, sf), "bri_group")


@register("welch_anova", Q.with_tagged("""
SELECT round(a0 / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1.0) * lam), 6) AS f_stat, CAST(k - 1 AS DOUBLE) AS df1,
       round((k * k - 1.0) / (3 * lam), 6) AS df2, k AS n_groups
FROM (SELECT count(*) AS k, sum(w * power(mean - mu, 2)) AS a0, sum(power(1 - w / ww, 2) / (n - 1)) AS lam
      FROM (SELECT *, sum(w) OVER () AS ww, sum(w * mean) OVER () / sum(w) OVER () AS mu
            FROM (SELECT year, count(amount) AS n, avg(amount) AS mean, n / var_samp(amount) AS w
                  FROM tagged GROUP BY year HAVING count(amount) >= 2 AND var_samp(amount) > 0)))"""))
def q_welch_anova(spark, sf):
    """T4: Welch one-way ANOVA of amount across years."""
    return _r(I.welch_anova(feat(spark, sf), "year", "amount"), skip=("df1",))


@register("welch_anova_tests", Q.with_tagged(f"""
SELECT round(f, 6) AS f_stat, d1 AS df1, round(d2, 6) AS df2, k AS n_groups, round({_f_p('f', 'd1', 'd2')}, 6) AS p_value FROM (
  SELECT a0 / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1.0) * lam) AS f, CAST(k - 1 AS DOUBLE) AS d1, (k * k - 1.0) / (3 * lam) AS d2, k
  FROM (SELECT count(*) AS k, sum(w * power(mean - mu, 2)) AS a0, sum(power(1 - w / ww, 2) / (n - 1)) AS lam
        FROM (SELECT *, sum(w) OVER () AS ww, sum(w * mean) OVER () / sum(w) OVER () AS mu
              FROM (SELECT year, count(amount) AS n, avg(amount) AS mean, n / var_samp(amount) AS w
                    FROM tagged GROUP BY year HAVING count(amount) >= 2 AND var_samp(amount) > 0))))"""))
def q_welch_anova_tests(spark, sf):
    """T4 (tests)"""
    return _r(I.welch_anova_tests(feat(spark, sf), "year", "amount"), skip=("df1",))


@register("pairwise_groups", Q.with_tagged("""
SELECT a.year AS group_a, b.year AS group_b, round(b.mean - a.mean, 6) AS mean_diff,
  round((b.mean - a.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t,
  round(power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)), 6) AS dof
FROM g a JOIN g b ON a.year < b.year""", PA,
                                         "g AS (SELECT year, count(amount) AS n, avg(amount) AS mean, var_samp(amount) AS var FROM tagged GROUP BY year HAVING count(amount) >= 2)"))
def q_pairwise_groups(spark, sf):
    """T5: pairwise Welch t between years."""
    return _r(I.pairwise_groups(feat(spark, sf), "year", "amount"))


@register("pairwise_groups_tests", Q.with_tagged(f"""
SELECT group_a, group_b, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(dof, 6) AS dof, round(p, 6) AS p_value,
  round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm,
  max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 0.05 AS significant
FROM (SELECT *, row_number() OVER (ORDER BY p, group_a, group_b) AS r, count(*) OVER () AS m FROM (
  SELECT *, {_t_p('t', 'dof')} AS p FROM (
    SELECT a.year AS group_a, b.year AS group_b, b.mean - a.mean AS mean_diff, (b.mean - a.mean) / sqrt(a.var / a.n + b.var / b.n) AS t,
      power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)) AS dof
    FROM g a JOIN g b ON a.year < b.year)))""", PA,
                                               "g AS (SELECT year, count(amount) AS n, avg(amount) AS mean, var_samp(amount) AS var FROM tagged GROUP BY year HAVING count(amount) >= 2)"))
def q_pairwise_groups_tests(spark, sf):
    """T5 (tests): Welch p-values of all pairs of years with Holm's adjustment."""
    return _r(I.pairwise_groups_tests(feat(spark, sf), "year", "amount"))


#: The studentized range in SQL: the normal distribution on a grid of width H (trapezoids with the end correction), and for each
#: pair a sum over s at multiples of H / q (the chi density, normalised) and over z at every tenth.
_H = 0.0002
_RANGE = f"""
g AS (SELECT year, count(amount) AS n, avg(amount) AS mean, var_samp(amount) AS var, count(*) OVER () AS k FROM tagged GROUP BY year HAVING count(amount) >= 2),
pr AS (SELECT a.year AS group_a, b.year AS group_b, b.mean - a.mean AS mean_diff, a.k,
         abs(b.mean - a.mean) / sqrt(a.var / a.n + b.var / b.n) * sqrt(2) AS q,
         power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)) AS dof
       FROM g a JOIN g b ON a.year < b.year),
nrm AS (SELECT i, x, d, {_H} * (sum(d) OVER (ORDER BY i) - d / 2) + {_H * _H / 12} * x * d AS c FROM
        (SELECT i, i * {_H} AS x, exp(-power(i * {_H}, 2) / 2) / sqrt(2 * pi()) AS d FROM range(-130000, 45001) r(i))),
sn AS (SELECT *, CAST(greatest(1, floor(q * 0.25 / sqrt(2 * dof) / {_H})) AS BIGINT) AS stride FROM pr),
nodes AS (SELECT group_a, group_b, k, m, (dof - 1) * ln(m * {_H} / q) - dof * power(m * {_H} / q, 2) / 2 AS lf FROM sn,
          LATERAL (SELECT unnest(range(greatest(1, CAST(floor(q * (1 - 9 / sqrt(2 * dof)) / {_H} / stride) AS BIGINT)),
                                       CAST(ceil(q * (1 + 9 / sqrt(2 * dof)) / {_H} / stride) AS BIGINT) + 1)) * stride AS m)),
wt AS (SELECT *, exp(lf - max(lf) OVER (PARTITION BY group_a, group_b)) AS f FROM nodes),
ins AS (SELECT group_a, group_b, m, any_value(f) AS f, any_value(k) * 0.1 * sum(z.d * power(greatest(z.c - lo.c, 0), k - 1)) AS inside
        FROM wt, (SELECT * FROM nrm WHERE i % 500 = 0 AND abs(i) <= 42500) z JOIN nrm lo ON lo.i = z.i - m GROUP BY ALL),
tails AS (SELECT group_a, group_b, greatest(0, least(1, 1 - sum(f * inside) / sum(f))) AS p FROM ins GROUP BY ALL)"""


@register("pairwise_range_tests", Q.with_tagged("""
SELECT group_a, group_b, round(mean_diff, 6) AS mean_diff, round(q, 6) AS q, round(dof, 6) AS dof, round(p, 5) AS p_value,
  round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS p_holm
FROM (SELECT *, row_number() OVER (ORDER BY p, group_a, group_b) AS r, count(*) OVER () AS m FROM pr JOIN tails USING (group_a, group_b))""", PA, _RANGE))
def q_pairwise_range_tests(spark, sf):
    """T5: pairs of years by the studentized range (unequal variances), with Holm's adjustment."""
    g = I.games_howell(feat(spark, sf), "year", "amount")
    return g.select("group_a", "group_b", *[F.round(c, 6).alias(c) for c in ("mean_diff", "q", "dof")], *[F.round(c, 5).alias(c) for c in ("p_value", "p_holm")])


@register("outlier_tags", Q.with_tagged("""
SELECT t.deal_id, t.sector, t.log_amount FROM tagged t JOIN
  (SELECT sector, quantile_cont(log_amount, 0.25) AS q1, quantile_cont(log_amount, 0.75) AS q3 FROM tagged GROUP BY sector) q
  ON q.sector = t.sector
WHERE t.log_amount < q1 - 1.5 * (q3 - q1) OR t.log_amount > q3 + 1.5 * (q3 - q1)"""))
def q_outlier_tags(spark, sf):
    """Tukey outliers of the log amount within each sector."""
    return I.outlier_tags(feat(spark, sf), "sector", "log_amount")


@register("box_summary", Q.with_tagged("""
SELECT t.deal_type, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  min(CASE WHEN amount >= q1 - 1.5 * (q3 - q1) AND amount <= q3 + 1.5 * (q3 - q1) THEN amount END) AS whisker_lo,
  max(CASE WHEN amount >= q1 - 1.5 * (q3 - q1) AND amount <= q3 + 1.5 * (q3 - q1) THEN amount END) AS whisker_hi,
  count(*) AS n
FROM tagged t JOIN (SELECT deal_type, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS med,
                           quantile_cont(amount, 0.75) AS q3 FROM tagged GROUP BY 1) q ON q.deal_type = t.deal_type
GROUP BY t.deal_type, q1, med, q3"""))
def q_box_summary(spark, sf):
    """Quartiles and whiskers per deal type."""
    b = I.box_summary(feat(spark, sf), "deal_type", "amount")
    return b.select("deal_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "whisker_lo",
                    "whisker_hi", "n")


def _hist_sql(col: str, bins: int) -> str:
    return f"""SELECT '{col}' AS variable, bin, round(lo + bin * (hi - lo) / {bins}, 6) AS edge, count(*) AS count FROM (
  SELECT CASE WHEN hi > lo THEN CAST(least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) ELSE 0 END AS bin, lo, hi
  FROM tagged, (SELECT min({col}) AS lo, max({col}) AS hi FROM tagged)) GROUP BY bin, lo, hi"""


@register("histogram", Q.with_tagged(_hist_sql("amount", 100) + " UNION ALL " + _hist_sql("log_amount", 50)))
def q_histogram(spark, sf):
    """100 equal bins of amount and 50 of log amount (non-empty bins)."""
    f = feat(spark, sf)
    a = I.histogram(f, "amount", 100).withColumn("variable", F.lit("amount"))
    b = I.histogram(f, "log_amount", 50).withColumn("variable", F.lit("log_amount"))
    return a.unionByName(b).withColumn("edge", F.round("edge", 6))


_RPH = Q.phases_values(PB)


@register("phase_histogram_ttest", Q.with_deals("""
SELECT replace(replace(p.label, 'Going_Global', 'Going Global '), '.0', '') AS phase, count(amount) AS n,
  round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS sd,
  round(avg(amount) / (stddev_samp(amount) / sqrt(count(amount))), 6) AS t
FROM deals JOIN phases p ON year BETWEEN p.lo AND p.hi
WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000
GROUP BY 1""", _RPH))
def q_phase_histogram_ttest(spark, sf):
    """Per R phase (capped 0 < amount <= cap), one-sample t of the mean."""
    from ..functions.scalar import phase_label_text
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True)
    j = R.phase_range_join(d.select("year", "amount"), PB).withColumn("phase", phase_label_text("phase_label"))
    return _r(I.one_sample_t(j, "phase", "amount"))


@register("phase_histogram_ttest_tests", Q.with_deals(f"""
SELECT phase, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, round({_t_p('t', 'n - 1')}, 6) AS p_value FROM (
  SELECT replace(replace(p.label, 'Going_Global', 'Going Global '), '.0', '') AS phase, count(amount) AS n, avg(amount) AS mean,
    stddev_samp(amount) AS sd, avg(amount) / (stddev_samp(amount) / sqrt(count(amount))) AS t
  FROM deals JOIN phases p ON year BETWEEN p.lo AND p.hi
  WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000 GROUP BY 1)""", _RPH))
def q_phase_histogram_ttest_tests(spark, sf):
    """T9 (tests): p-value of the per-phase one-sample t."""
    from ..functions.scalar import phase_label_text
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True)
    j = R.phase_range_join(d.select("year", "amount"), PB).withColumn("phase", phase_label_text("phase_label"))
    return _r(I.one_sample_t_tests(j, "phase", "amount"))


@register("phase_histogram", Q.with_deals("""
SELECT phase, bin, round(lo + bin * (hi - lo) / 30, 6) AS edge, count(*) AS count FROM (
  SELECT phase, CASE WHEN hi > lo THEN CAST(least(floor((amount - lo) / ((hi - lo) / 30)), 29) AS INT) ELSE 0 END AS bin, lo, hi
  FROM (SELECT p.label AS phase, amount, min(amount) OVER (PARTITION BY p.label) AS lo,
               max(amount) OVER (PARTITION BY p.label) AS hi
        FROM deals JOIN phases p ON year BETWEEN p.lo AND p.hi
        WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000))
GROUP BY phase, bin, lo, hi""", _RPH))
def q_phase_histogram(spark, sf):
    """Per R phase histogram (30 bins)."""
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True)
    j = R.phase_range_join(d.select("year", "amount"), PB).withColumnRenamed("phase_label", "phase")
    return I.histogram(j, "amount", 30, group="phase").withColumn("edge", F.round("edge", 6))


@register("grouped_density", Q.with_deals("""
SELECT region, CAST(j AS INT) AS grid_index, round(lo + j * step, 4) AS x, round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))), 6) AS weight,
       round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM (SELECT cells.region, cell, c, n, bw, step, lo, unnest(range(512)) AS j
      FROM (SELECT region, CAST(i + s AS INT) AS cell, sum(CASE s WHEN 0 THEN 1 - (pos - i) ELSE pos - i END) AS c
            FROM (SELECT d.region, (amount - lo) / step AS pos, least(floor((amount - lo) / step), 510) AS i FROM dr d JOIN st ON st.region = d.region),
                 (VALUES (0), (1)) two(s) GROUP BY 1, 2) cells
      JOIN st ON st.region = cells.region)
GROUP BY region, j, n, bw, step, lo""", """
dr AS (SELECT region, amount FROM deals WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000),
st0 AS (SELECT region, count(amount) AS n, min(amount) AS mn, max(amount) AS mx,
        0.9 * CASE WHEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) > 0 THEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) WHEN stddev_samp(amount) > 0 THEN stddev_samp(amount)
                   WHEN min(amount) <> 0 THEN abs(min(amount)) ELSE 1.0 END * power(count(amount), -0.2) AS bw FROM dr GROUP BY region),
st1 AS (SELECT * EXCLUDE (bw), avg(bw) OVER () AS bw FROM st0),
st AS (SELECT *, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 511 AS step FROM st1)"""))
def q_grouped_density(spark, sf):
    """Kernel density of amount per region, one bandwidth for all ridgelines (0 < amount <= cap)."""
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True)
    k = I.grouped_density(d, "region", "amount", rule="shared")
    return k.select("region", "grid_index", F.round("x", 4).alias("x"), F.round("weight", 6).alias("weight"),
                    F.round("density", 12).alias("density"))


@register("grouped_density_year_log10", Q.with_tagged("""
SELECT year, CAST(j AS INT) AS grid_index, round(lo + j * step, 6) AS x,
       round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))), 6) AS weight,
       round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))) / (n * bw * sqrt(2 * pi())), 9) AS density
FROM (SELECT cells.year, cell, c, n, bw, step, lo, unnest(range(512)) AS j
      FROM (SELECT year, CAST(i + s AS INT) AS cell, sum(CASE s WHEN 0 THEN 1 - (pos - i) ELSE pos - i END) AS c
            FROM (SELECT d.year, (v - lo) / step AS pos, least(floor((v - lo) / step), 510) AS i FROM dr d JOIN st ON st.year = d.year),
                 (VALUES (0), (1)) two(s) GROUP BY 1, 2) cells
      JOIN st ON st.year = cells.year)
GROUP BY year, j, n, bw, step, lo""", PA, """
dr AS (SELECT year, log10(amount) AS v FROM tagged WHERE amount > 0),
st0 AS (SELECT year, count(v) AS n, min(v) AS mn, max(v) AS mx,
        CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) WHEN min(v) <> 0 THEN abs(min(v)) ELSE 1.0 END * power(count(v), -0.2) AS bw FROM dr GROUP BY year),
st AS (SELECT *, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 511 AS step FROM st0)"""))
def q_grouped_density_year_log10(spark, sf):
    """T10/P5 (ridgeline variant): density of log10 amount per year by Scott's rule (positive amounts)."""
    from ..operators.clean import positive_log10
    d = positive_log10(feat(spark, sf)).select("year", F.col("log10_amount").alias("v"))
    k = I.grouped_density(d, "year", "v", rule="scott")
    return k.select("year", "grid_index", F.round("x", 6).alias("x"), F.round("weight", 6).alias("weight"),
                    F.round("density", 9).alias("density"))


_DENS_VARS = ["subsector", "region", "month", "sector", "bri_group"]


@register("grouped_density_r", Q.with_deals("""
SELECT gkey, CAST(j AS INT) AS grid_index, round(lo + j * step, 4) AS x,
       round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))), 6) AS weight
FROM (SELECT cells.gkey, cell, c, n, bw, step, lo, unnest(range(512)) AS j
      FROM (SELECT gkey, CAST(i + s AS INT) AS cell, sum(CASE s WHEN 0 THEN 1 - (pos - i) ELSE pos - i END) AS c
            FROM (SELECT d.gkey, (amount - lo) / step AS pos, least(floor((amount - lo) / step), 510) AS i FROM dr d JOIN st ON st.gkey = d.gkey),
                 (VALUES (0), (1)) two(s) GROUP BY 1, 2) cells
      JOIN st ON st.gkey = cells.gkey)
GROUP BY gkey, j, n, bw, step, lo""", """
base AS (SELECT amount, COALESCE(subsector, 'Unknown') AS subsector, COALESCE(region, 'Unknown') AS region,
                COALESCE(monthname(make_date(2000, month, 1)), 'Unknown') AS month, COALESCE(sector, 'Unknown') AS sector,
                CASE WHEN lower(trim(bri)) IN ('1', 'bri', 'y', 'yes', 'sim', 'true') THEN 'BRI' ELSE 'Others' END AS bri_group
         FROM deals WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000),
dr AS (SELECT variable || '=' || level AS gkey, amount FROM
       (UNPIVOT base ON subsector, region, month, sector, bri_group INTO NAME variable VALUE level)),
st0 AS (SELECT gkey, count(amount) AS n, min(amount) AS mn, max(amount) AS mx,
        0.9 * CASE WHEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) > 0 THEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) WHEN stddev_samp(amount) > 0 THEN stddev_samp(amount)
                   WHEN min(amount) <> 0 THEN abs(min(amount)) ELSE 1.0 END * power(count(amount), -0.2) AS bw FROM dr GROUP BY gkey),
st AS (SELECT *, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 511 AS step FROM st0)"""))
def q_grouped_density_r(spark, sf):
    """T10 (R rules, all grouping variables in one pass): rows unpivoted to
    (variable, level) keys, then one kernel density per key on 0 < amount <= cap."""
    from ..functions.scalar import is_bri, month_name, unknown_level
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True)
    base = d.select("amount", *[unknown_level(c).alias(c) for c in ("subsector", "region")],
                    unknown_level(month_name("month")).alias("month"), unknown_level("sector").alias("sector"),
                    is_bri("bri").alias("bri_group"))
    long = base.unpivot(["amount"], _DENS_VARS, "variable", "level").select(
        F.concat_ws("=", "variable", "level").alias("gkey"), "amount")
    k = I.grouped_density(long, "gkey", "amount")
    return k.select("gkey", "grid_index", F.round("x", 4).alias("x"), F.round("weight", 6).alias("weight"))


@register("grouped_density_top_parties", Q.with_deals("""
SELECT party, CAST(j AS INT) AS grid_index, round(lo + j * step, 4) AS x,
       round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))), 6) AS weight
FROM (SELECT cells.party, cell, c, n, bw, step, lo, unnest(range(512)) AS j
      FROM (SELECT party, CAST(i + s AS INT) AS cell, sum(CASE s WHEN 0 THEN 1 - (pos - i) ELSE pos - i END) AS c
            FROM (SELECT d.party, (amount - lo) / step AS pos, least(floor((amount - lo) / step), 510) AS i FROM dr d JOIN st ON st.party = d.party),
                 (VALUES (0), (1)) two(s) GROUP BY 1, 2) cells
      JOIN st ON st.party = cells.party)
GROUP BY party, j, n, bw, step, lo""", """
filt AS (SELECT party, amount FROM deals WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000),
tp AS (SELECT party FROM (SELECT party, rank() OVER (ORDER BY count(*) DESC) AS r FROM filt GROUP BY party) WHERE r <= 25),
dr AS (SELECT party, amount FROM filt WHERE party IN (SELECT party FROM tp)),
st0 AS (SELECT party, count(amount) AS n, min(amount) AS mn, max(amount) AS mx,
        0.9 * CASE WHEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) > 0 THEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) WHEN stddev_samp(amount) > 0 THEN stddev_samp(amount)
                   WHEN min(amount) <> 0 THEN abs(min(amount)) ELSE 1.0 END * power(count(amount), -0.2) AS bw FROM dr GROUP BY party),
st AS (SELECT *, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 511 AS step FROM st0)"""))
def q_grouped_density_top_parties(spark, sf):
    """T10 + P6/W8 (R rules): density of amount for the top-25 counter-parties by
    deal count (ties kept), on 0 < amount <= cap."""
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True).select("party", "amount")
    top = R.top_n_with_ties(d, "party", 25).select("party")
    kept = d.join(top, "party", "left_semi")
    k = I.grouped_density(kept, "party", "amount")
    return k.select("party", "grid_index", F.round("x", 4).alias("x"), F.round("weight", 6).alias("weight"))


@register("grouped_density_top_shares", Q.with_deals("""
SELECT share_size, CAST(j AS INT) AS grid_index, round(lo + j * step, 4) AS x,
       round(sum(c * exp(-0.5 * power((j - cell) * step / bw, 2))), 6) AS weight
FROM (SELECT cells.share_size, cell, c, n, bw, step, lo, unnest(range(512)) AS j
      FROM (SELECT share_size, CAST(i + s AS INT) AS cell, sum(CASE s WHEN 0 THEN 1 - (pos - i) ELSE pos - i END) AS c
            FROM (SELECT d.share_size, (amount - lo) / step AS pos, least(floor((amount - lo) / step), 510) AS i FROM dr d JOIN st ON st.share_size = d.share_size),
                 (VALUES (0), (1)) two(s) GROUP BY 1, 2) cells
      JOIN st ON st.share_size = cells.share_size)
GROUP BY share_size, j, n, bw, step, lo""", """
filt AS (SELECT share_size, amount FROM deals WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND amount <= 320000),
tp AS (SELECT share_size FROM (SELECT share_size, rank() OVER (ORDER BY count(*) DESC) AS r FROM filt GROUP BY share_size)
       WHERE r <= 30),
dr AS (SELECT share_size, amount FROM filt WHERE share_size IN (SELECT share_size FROM tp)),
st0 AS (SELECT share_size, count(amount) AS n, min(amount) AS mn, max(amount) AS mx,
        0.9 * CASE WHEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) > 0 THEN least(coalesce(stddev_samp(amount), 0), (quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25)) / 1.34) WHEN stddev_samp(amount) > 0 THEN stddev_samp(amount)
                   WHEN min(amount) <> 0 THEN abs(min(amount)) ELSE 1.0 END * power(count(amount), -0.2) AS bw FROM dr GROUP BY share_size),
st AS (SELECT *, mn - 3 * bw AS lo, (mx - mn + 6 * bw) / 511 AS step FROM st0)"""))
def q_grouped_density_top_shares(spark, sf):
    """T10 + W8 (R rules): density of amount for the 30 most frequent share sizes
    (ties kept), on 0 < amount <= cap."""
    d = cap_outliers(clean_rows_r(deals(spark, sf)), PB.density_cap, positive=True).select("share_size", "amount")
    top = R.top_n_with_ties(d, "share_size", 30).select("share_size")
    kept = d.join(top, "share_size", "left_semi")
    k = I.grouped_density(kept, "share_size", "amount")
    return k.select("share_size", "grid_index", F.round("x", 4).alias("x"), F.round("weight", 6).alias("weight"))
