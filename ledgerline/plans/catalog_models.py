"""Preparation, metric, model, many-series and causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PRESET_A
from ..operators import models as MD
from ..operators import prep as P
from ..operators import series as SE
from ..operators.clean import complete_cases
from ..operators.common import scalars
from ..operators.features import features
from ..operators.shapley import Tree, measured_tree, shapley_values
from ..session import scratch_path
from ..sources.deals import table
from . import sql as Q
from .registry import register

PA = PRESET_A


def feat(spark, sf):
    return features(spark, sf, PA)


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_M1_NUM = ["year", "roll_std_2", "sector_blend"]


def _scaled_sql(cols):
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med" for c in cols)
    imp = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT {c}_med FROM med)) AS {c}" for c in cols)
    out = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in cols)
    return med, imp, out


@register("prep_linear", Q.with_features(f"""
SELECT deal_id, {_scaled_sql(_M1_NUM)[2]},
  CAST(deal_type = 'Greenfield' AS INT) AS "deal_type=Greenfield", CAST(deal_type = 'M&A' AS INT) AS "deal_type=M&A",
  CAST(phase = 'p1' AS INT) AS "phase=p1", CAST(phase = 'p2' AS INT) AS "phase=p2", CAST(phase = 'p3' AS INT) AS "phase=p3"
FROM (SELECT deal_id, deal_type, phase, {_scaled_sql(_M1_NUM)[1]} FROM feat)""", PA,
                                           f"med AS (SELECT {_scaled_sql(_M1_NUM)[0]} FROM feat)"))
def q_prep_linear(spark, sf):
    """M1: median impute + standardise (population std), one-hot of the levels."""
    f = feat(spark, sf)
    ns, lv = P.fit_numeric(f, _M1_NUM), P.fit_levels(f, ["deal_type", "phase"])
    return _r(P.prep_linear(f, ns, lv, ["deal_id"]))


_M2_CAT = ["sector", "region", "deal_type", "phase", "post_policy"]


@register("prep_tree", Q.with_features(f"""
SELECT deal_id, {_scaled_sql(_M1_NUM)[2]}, {", ".join(f"CAST(dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS INT) AS {c}_ord" for c in _M2_CAT)}
FROM (SELECT deal_id, {", ".join(_M2_CAT)}, {_scaled_sql(_M1_NUM)[1]} FROM feat)""", PA,
                                         f"med AS (SELECT {_scaled_sql(_M1_NUM)[0]} FROM feat)"))
def q_prep_tree(spark, sf):
    """M2: median impute + standardise, ordinal codes (unseen -> -1)."""
    f = feat(spark, sf)
    ns, lv = P.fit_numeric(f, _M1_NUM), P.fit_levels(f, _M2_CAT)
    return _r(P.prep_tree(f, ns, lv, ["deal_id"]))


@register("split_stratified", Q.with_features("""
SELECT deal_id, adaptive_target, CAST(row_number() OVER (PARTITION BY adaptive_target ORDER BY md5(deal_id || '-42')) - 1
         < round(0.3 * count(*) OVER (PARTITION BY adaptive_target)) AS INT) AS is_test FROM feat"""))
def q_split_stratified(spark, sf):
    """M3: exact per-class 70/30 split (deterministic hash order), every deal's part."""
    return P.split_stratified(feat(spark, sf), "adaptive_target").select("deal_id", "adaptive_target", "is_test")


@register("folds_stratified", Q.with_features("""
SELECT deal_id, adaptive_target, CAST((row_number() OVER (PARTITION BY adaptive_target ORDER BY md5(deal_id || '-43')) - 1) % 5 AS INT) AS fold FROM feat"""))
def q_folds_stratified(spark, sf):
    """M4: 5 stratified folds, every deal's fold."""
    return P.folds_stratified(feat(spark, sf), "adaptive_target", 5).select("deal_id", "adaptive_target", "fold")


@register("folds_expanding", Q.with_features("""
SELECT deal_id, position,
  CASE WHEN rel >= 0 AND floor(rel / ts) >= uf THEN CAST(floor(rel / ts) AS INT) END AS test_fold,
  CASE WHEN greatest(CASE WHEN rel < 0 THEN 0 ELSE floor(rel / ts) + 1 END, uf) < 5
       THEN CAST(greatest(CASE WHEN rel < 0 THEN 0 ELSE floor(rel / ts) + 1 END, uf) AS INT) END AS first_train_fold
FROM (SELECT deal_id, position, ts, position - (n - 5 * ts) AS rel, greatest(ceil((20 - (n - 5 * ts)) / ts), 0) AS uf
      FROM (SELECT deal_id, row_number() OVER (ORDER BY year, deal_id) - 1 AS position, count(*) OVER () AS n,
                   floor(count(*) OVER () / 6) AS ts FROM feat))"""))
def q_folds_expanding(spark, sf):
    """M5: expanding-window folds on (year, deal_id) order."""
    return P.folds_expanding(feat(spark, sf), 5).select("deal_id", "position", "test_fold", "first_train_fold")


@register("mape_rmse", Q.with_features("""
SELECT phase, round(sqrt(avg(power(log_amount - sector_blend, 2))), 6) AS rmse_log,
  round(avg(abs(exp(log_amount) - greatest(exp(sector_blend), 0.1)) / greatest(exp(log_amount), 1.0)) * 100, 6) AS mape,
  count(*) AS n FROM feat GROUP BY phase"""))
def q_mape_rmse(spark, sf):
    """M7 on the group-mean baseline prediction of log amount, per phase."""
    m = P.regression_metrics(feat(spark, sf), "log_amount", "sector_blend", ["phase"])
    return _r(m)


_LAB = "lab AS (SELECT l.doc_id, l.quality, CAST(d.n_chars AS DOUBLE) / max(d.n_chars) OVER () AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _lab(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    mx = scalars(j.agg(F.max("n_chars").alias("mx")))["mx"]
    return j.select("doc_id", "quality", (F.col("n_chars").cast("double") / F.lit(float(mx))).alias("score"))


@register("roc_auc", f"""WITH {_LAB}
SELECT round((sum(CASE WHEN quality = 1 THEN r END) - p * (p + 1) / 2.0) / (p * (n - p)), 9) AS auc,
       round(avg(CASE WHEN (score > 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM (SELECT quality, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
             sum(quality) OVER () AS p, count(*) OVER () AS n FROM lab)
GROUP BY p, n""")
def q_roc_auc(spark, sf):
    """M9: rank AUC (ties half) and accuracy at 0.5 of a length score for the
    document quality label."""
    d = _lab(spark, sf)
    auc = P.roc_auc(d, "quality", "score")
    acc = scalars(P.accuracy(d.withColumn("pred", (F.col("score") > 0.5).cast("int")), "quality", "pred"))["accuracy"]
    return auc.select(F.round("auc", 9).alias("auc"), F.round(F.lit(acc), 9).alias("accuracy"))


_EDGES = " + ".join(f"CAST(score > {repr(e)} AS INT)" for e in P.CAL_EDGES)


@register("calibration_curve", f"""WITH {_LAB}
SELECT {_EDGES} AS bin, round(avg(score), 9) AS prob_pred, round(avg(CAST(quality AS DOUBLE)), 9) AS prob_true,
       count(*) AS n FROM lab GROUP BY 1""")
def q_calibration_curve(spark, sf):
    """M10"""
    c = P.calibration_curve(_lab(spark, sf), "quality", "score")
    return c.select("bin", F.round("prob_pred", 9).alias("prob_pred"), F.round("prob_true", 9).alias("prob_true"), "n")


@register("pr_curve", f"""WITH {_LAB}
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp), 9) AS precision, round(tp / pp, 9) AS recall FROM (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pp
  FROM (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM lab GROUP BY score)
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def q_pr_curve(spark, sf):
    """M11"""
    c = P.pr_curve(_lab(spark, sf), "quality", "score")
    return c.select("threshold", "tp", "fp", F.round("precision", 9).alias("precision"),
                    F.round("recall", 9).alias("recall"))


@register("class_weight", Q.with_features("""
SELECT adaptive_target, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight
FROM (SELECT adaptive_target, count(*) AS n FROM feat GROUP BY 1)"""))
def q_class_weight(spark, sf):
    """Balanced class weights of the adaptive target."""
    w = P.class_weight(feat(spark, sf), "adaptive_target")
    return w.select("adaptive_target", "n", F.round("weight", 9).alias("weight"))


_SEARCHES: dict[tuple, str] = {}


def _search(spark, sf):
    """The regression search's summary: searched once per session, then read from the shared folder."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _SEARCHES:
        path = scratch_path(spark, "search")
        MD.tune_regression(feat(spark, sf))[0].coalesce(1).write.parquet(path)
        _SEARCHES[key] = path
    return spark.read.parquet(_SEARCHES[key])


@register("tune_regression")
def q_tune_regression(spark, sf):
    """M6: expanding-window grid search of 160 settings of boosted trees and forests for log amount, each on every fold."""
    return _search(spark, sf)


@register("search_fold_rows", Q.with_features("""
SELECT CAST(f AS INT) AS fold, count(*) FILTER (first_train_fold <= f) AS n_train, count(*) FILTER (test_fold = f) AS n_test
FROM (SELECT CASE WHEN rel >= 0 AND floor(rel / ts) >= uf THEN floor(rel / ts) END AS test_fold,
             greatest(CASE WHEN rel < 0 THEN 0 ELSE floor(rel / ts) + 1 END, uf) AS first_train_fold
      FROM (SELECT ts, position - (n - 5 * ts) AS rel, greatest(ceil((20 - (n - 5 * ts)) / ts), 0) AS uf
            FROM (SELECT row_number() OVER (ORDER BY year, deal_id) - 1 AS position, count(*) OVER () AS n, floor(count(*) OVER () / 6) AS ts
                  FROM feat WHERE log_amount IS NOT NULL))), range(5) r(f)
GROUP BY f"""))
def q_search_fold_rows(spark, sf):
    """M6: rows that each fold of the search trains on and tests."""
    return MD.fold_rows(MD.search_table(feat(spark, sf))[0])


@register("tune_classification")
def q_tune_classification(spark, sf):
    """M8: stratified grid search of 32 settings of tree classifiers for the adaptive target, each on every fold."""
    s, _ = MD.tune_classification(feat(spark, sf))
    return s


def _attributed(spark, sf):
    """The search's winner fitted again on the complete rows, those rows, all rows with a target, and the names."""
    f = complete_cases(feat(spark, sf), ["log_amount"])
    full = complete_cases(f, [*P.ML_NUMERIC, *P.ML_CATEGORICAL])
    full, every = (d.select("deal_id", "label", "features") for d in MD.design(full, [f], P.ML_NUMERIC, P.ML_CATEGORICAL, "log_amount", ["deal_id"]))
    model = MD.refit_winner(_search(spark, sf), full)
    return full, every, model, list(P.ML_NUMERIC) + [f"{c}_ord" for c in P.ML_CATEGORICAL]


@register("feature_attribution")
def q_feature_attribution(spark, sf):
    """Per-row Shapley values of the regression search's winner, refitted on the complete rows, features
    ranked by mean |phi|; tasks return sums, not rows."""
    from pyspark.sql import Window
    full, _, model, names = _attributed(spark, sf)
    sums = MD.attribution_sums(full, model, names).groupBy("feature").agg(F.sum("abs_phi").alias("a"), F.sum("n").alias("n"))
    imp = sums.select("feature", (F.col("a") / F.col("n")).alias("mean_abs_phi"))
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_phi"), "feature")).cast("int"))


@register("attribution_identity", Q.with_features("SELECT count(*) AS n, CAST(0 AS DOUBLE) AS max_error FROM feat WHERE log_amount IS NOT NULL"))
def q_attribution_identity(spark, sf):
    """Base + attributions = prediction on every row (largest rounded error)."""
    _, every, model, names = _attributed(spark, sf)
    s = MD.attribution_sums(model.transform(every), model, names).where(F.col("feature") == names[0])
    return s.agg(F.sum("n").alias("n"), F.round(F.max("max_error"), 6).alias("max_error"))


#: Two small trees on four columns: (column, threshold, left, right), None a leaf. Each weighs one half.
_SHAPES = [("year", 1998, ("sector_code", 1, None, ("year", 1996, None, None)), ("region_code", 2, None, ("sector_code", 2, None, None))),
           ("month", 6, ("region_code", 1, None, ("month", 3, None, None)), ("year", 1997, None, ("region_code", 3, None, None)))]
_PLAYERS = ["year", "sector_code", "region_code", "month"]


def _coalition_sql(shape, tree: int):
    """(value of the coalition s in SQL, [(condition, leaf number)]) of a shape: splits on columns outside s average by covers."""
    found: list[tuple[str, int]] = []

    def walk(node, cond):
        if node is None:
            found.append((cond, len(found)))
            return f"v{tree}_{len(found) - 1}", f"n{tree}_{len(found) - 1}"
        column, t, low, high = node
        a, na = walk(low, f"{cond} AND {column} <= {t}")
        b, nb = walk(high, f"{cond} AND {column} > {t}")
        bit = 1 << _PLAYERS.index(column)
        return (f"CASE WHEN (s & {bit}) > 0 THEN CASE WHEN {column} <= {t} THEN {a} ELSE {b} END "
                f"ELSE coalesce((({na}) * ({a}) + ({nb}) * ({b})) / nullif(({na}) + ({nb}), 0), 0) END"), f"{na} + {nb}"

    return walk(shape, "true")[0], found


def _shapley_sql():
    parts = [_coalition_sql(shape, i) for i, shape in enumerate(_SHAPES)]
    leaf = ", ".join(f"CAST(count(*) FILTER ({c}) AS DOUBLE) AS n{i}_{k}, coalesce(avg(log_amount) FILTER ({c}), 0) AS v{i}_{k}"
                     for i, (_, found) in enumerate(parts) for c, k in found)
    val = " + ".join(f"0.5 * ({v})" for v, _ in parts)
    phi = ", ".join(f"round(sum(CASE WHEN (s & {1 << j}) > 0 THEN val * w_in ELSE -val * w_out END), 6) AS phi_{c}" for j, c in enumerate(_PLAYERS))
    # a coalition of k players weighs (k-1)!(4-k)!/4! with the player inside, k!(3-k)!/4! without
    return Q.with_features(f"""SELECT deal_id, {phi}, round(max(CASE WHEN s = 0 THEN val END), 6) AS base, round(max(CASE WHEN s = 15 THEN val END), 6) AS prediction
FROM (SELECT deal_id, s, {val} AS val, [0, 1/4, 1/12, 1/12, 1/4][bit_count(s) + 1] AS w_in, [1/4, 1/12, 1/12, 1/4, 0][bit_count(s) + 1] AS w_out
      FROM feat, lf, (SELECT CAST(range AS INTEGER) AS s FROM range(16)) WHERE log_amount IS NOT NULL) GROUP BY deal_id""", PA,
                           f"lf AS (SELECT {leaf} FROM feat WHERE log_amount IS NOT NULL)")


@register("shapley_coalitions", _shapley_sql())
def q_shapley_coalitions(spark, sf):
    """M13 on two small trees with counted covers and mean log amounts in their leaves: every deal's Shapley values."""
    f = feat(spark, sf).where(F.col("log_amount").isNotNull()).select("deal_id", "log_amount", *_PLAYERS)
    trees = []
    for shape in _SHAPES:
        t, names = measured_tree(f, shape, "log_amount", 0.5)
        trees.append(Tree(t.weight, t.left, t.right, [_PLAYERS.index(names[k]) if k >= 0 else -1 for k in t.feature], t.threshold, t.value, t.cover))
    return _r(shapley_values(f, trees, _PLAYERS, "deal_id"))


def _series(spark, sf):
    return SE.monthly_series(feat(spark, sf), "country")


@register("future_spine", Q.with_tagged("""
SELECT country, CAST(s + 1 AS INT) AS step, make_date(y0 + s, 12, 31) AS ds FROM (
  SELECT country, CASE WHEN last >= make_date(year(last), 12, 31) THEN year(last) + 1 ELSE year(last) END AS y0
  FROM (SELECT country, max(make_date(year, month, 1)) AS last FROM tagged GROUP BY country)),
  range(5) t(s)"""))
def q_future_spine(spark, sf):
    """Next five year-end dates per series."""
    return SE.future_spine(_series(spark, sf), "country")


_FILLED = """ser AS (SELECT country, make_date(year, month, 1) AS ds, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS y FROM tagged GROUP BY ALL),
span AS (SELECT country, min(ds) AS first, max(ds) AS last FROM ser GROUP BY country),
fil AS (SELECT s.country, CAST(g.ds AS DATE) AS ds, datediff('month', first, CAST(g.ds AS DATE)) AS t, coalesce(y, 0) AS y, ln(1 + coalesce(y, 0)) AS ly
        FROM span s CROSS JOIN LATERAL (SELECT unnest(generate_series(s.first, s.last, INTERVAL 1 MONTH)) AS ds) g
        LEFT JOIN ser ON ser.country = s.country AND ser.ds = CAST(g.ds AS DATE))"""


def _least_squares(rows: str, xs: list[str], y: str, name: str) -> str:
    """CTEs that regress ``y`` on ``xs`` by country over the rows with use = true, by modified Gram-Schmidt: the last one,
    ``name``, has every row's ``fitted`` value (a row with use = false is only predicted, its y counts as 0)."""
    out, before = [], rows
    for k in range(len(xs)):
        later = [f"{x} - (sum({x} * {xs[k]}) FILTER (use) OVER c) / nullif(sum({xs[k]} * {xs[k]}) FILTER (use) OVER c, 0) * {xs[k]} AS {x}"
                 for x in [*xs[k + 1:], "res"]]
        source = f"(SELECT *, CASE WHEN use THEN {y} ELSE 0 END AS res FROM {before})" if k == 0 else before
        out.append(f"{name}{k} AS (SELECT * REPLACE ({', '.join(later)}) FROM {source} WINDOW c AS (PARTITION BY country))")
        before = f"{name}{k}"
    return ",\n".join([*out, f"{name} AS (SELECT *, CASE WHEN use THEN {y} ELSE 0 END - res AS fitted FROM {before})"])


_LAGS = range(1, SE.LONG_LAGS + 1)
_ARIMA = _FILLED + f""",
dif AS (SELECT *, {", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in _LAGS)} FROM
        (SELECT *, ly - lag(ly) OVER (PARTITION BY country ORDER BY ds) AS d FROM fil) WINDOW w AS (PARTITION BY country ORDER BY ds)),
lng AS (SELECT country, ds, d, d1, true AS use, 1.0 AS c0, {", ".join(f"d{k} AS c{k}" for k in _LAGS)} FROM dif WHERE d{SE.LONG_LAGS} IS NOT NULL),
{_least_squares("lng", ["c0", *[f"c{k}" for k in _LAGS]], "d", "ar")},
inn AS (SELECT country, d, d1 AS x1, lag(d - fitted) OVER (PARTITION BY country ORDER BY ds) AS x2 FROM ar),
ask AS (SELECT country, d, 1.0 AS x0, x1, x2, true AS use, 0 AS probe FROM inn WHERE x2 IS NOT NULL
        UNION ALL SELECT country, 0, CAST(p = 1 AS INT), CAST(p = 2 AS INT), CAST(p = 3 AS INT), false, p FROM (SELECT DISTINCT country FROM inn), range(1, 4) r(p)),
{_least_squares("ask", ["x0", "x1", "x2"], "d", "arma")},
fit AS (SELECT country, count(*) FILTER (use) AS n, max(fitted) FILTER (probe = 1) AS const, max(fitted) FILTER (probe = 2) AS phi,
               max(fitted) FILTER (probe = 3) AS theta, sum(res * res) FILTER (use) AS sse FROM arma GROUP BY country),
kept AS (SELECT country, const, sse / (n - 3) AS sigma2, greatest(least(phi, {SE.ROOT_BOUND}), -{SE.ROOT_BOUND}) AS phi,
                greatest(least(theta, {SE.ROOT_BOUND}), -{SE.ROOT_BOUND}) AS theta FROM fit),
lst AS (SELECT country, arg_max(ly, ds) AS last_ly, arg_max(d, ds) AS last_d, max(t) AS last_t FROM dif GROUP BY country),
fin AS (SELECT country, any_value(const) AS const, any_value(sigma2) AS sigma2, any_value(phi) AS phi, any_value(theta) AS theta, any_value(last_ly) AS last_ly,
               any_value(last_d) AS last_d, sum(power(-theta, last_t - t) * (d - const - phi * d1)) AS last_e
        FROM dif JOIN kept USING (country) JOIN lst USING (country) WHERE d1 IS NOT NULL GROUP BY country)"""


@register("arima_fit_many", Q.with_tagged("SELECT country, n, round(phi, 6) AS phi, round(theta, 6) AS theta, round(const, 6) AS const, round(sigma2, 6) AS sigma2, "
                                          "round(n * ln(sse / n) + 6, 4) AS aic FROM fit JOIN (SELECT country, sse / (n - 3) AS sigma2 FROM fit) USING (country)", PA, _ARIMA))
def q_arima_fit_many(spark, sf):
    """G1 (fit table): ARIMA(1,1,1) by two regressions per nation on filled monthly log totals."""
    f = SE.arima_fit(_series(spark, sf), "country")
    return f.select("country", "n", *[F.round(c, 6).alias(c) for c in ("phi", "theta", "const", "sigma2")], F.round("aic", 4).alias("aic"))


@register("forecast_arima_many", Q.with_tagged("""
SELECT country, CAST(h AS INT) AS step, round(ly, 6) AS log_forecast, round(ly - 1.959963984540054 * sqrt(sigma2 * w), 6) AS log_lower,
       round(ly + 1.959963984540054 * sqrt(sigma2 * w), 6) AS log_upper, round(exp(ly) - 1, 2) AS forecast
FROM (SELECT country, h, sigma2, (SELECT sum(power(1 + (phi + theta) * (1 - power(phi, i)) / (1 - phi), 2)) FROM range(0, h) r(i)) AS w,
             last_ly + h * const / (1 - phi) + (const + phi * last_d + theta * last_e - const / (1 - phi)) * (1 - power(phi, h)) / (1 - phi) AS ly
      FROM fin, range(1, 6) t(h))""", PA, _ARIMA))
def q_forecast_arima_many(spark, sf):
    """G1: five monthly steps per nation with interval."""
    f = SE.forecast_arima_many(_series(spark, sf), "country")
    return f.select("country", "step", *[F.round(c, 6).alias(c) for c in ("log_forecast", "log_lower", "log_upper")], F.round("forecast", 2).alias("forecast"))


_LINE = {"b0": "1.0", "b1": "s", **{f"b{k + 2}": f"greatest(s - {0.8 * (k + 1) / (SE.CHANGES + 1)!r}, 0)" for k in range(SE.CHANGES)}}
_WAVE = {f"w{2 * k + i}": f"{f}({k + 1} * 2 * pi() / 12 * (m - 1))" for k in range(SE.WAVES) for i, f in enumerate(("sin", "cos"))}
_RIDGE = {**{b: 1e-6 if b in ("b0", "b1") else SE.CHANGE_RIDGE for b in _LINE}, **{w: SE.WAVE_RIDGE for w in _WAVE}}
_SEASON = _FILLED + f""",
span2 AS (SELECT country, min(ds) AS first, max(ds) AS last, greatest(max(t), 1) AS len FROM fil GROUP BY country),
pts AS (SELECT country, ds, t, y, ly, false AS is_forecast FROM fil UNION ALL
        SELECT country, make_date(CAST(y0 + s AS BIGINT), 12, 31), datediff('month', first, make_date(CAST(y0 + s AS BIGINT), 12, 31)), NULL, NULL, true
        FROM (SELECT country, first, CASE WHEN last >= make_date(year(last), 12, 31) THEN year(last) + 1 ELSE year(last) END AS y0 FROM span2), range(5) r(s)),
sca AS (SELECT country, ds, y, ly, is_forecast, CAST(t AS DOUBLE) / len AS s, month(ds) AS m FROM pts JOIN span2 USING (country)),
xs AS (SELECT country, ds, y, ly, is_forecast, NOT is_forecast AS use, 0 AS probe, {", ".join(f"{e} AS {b}" for b, e in {**_LINE, **_WAVE}.items())} FROM sca
       UNION ALL SELECT country, ds, y, ly, is_forecast, false, 1, {", ".join(f"{e} AS {b}" for b, e in _LINE.items())}, {", ".join("0" for _ in _WAVE)} FROM sca
       UNION ALL SELECT country, NULL, NULL, 0, NULL, true, 2, {", ".join(f"CASE WHEN r.j = {k} THEN sqrt({lam!r}) ELSE 0 END" for k, lam in enumerate(_RIDGE.values()))}
                 FROM span2, range({len(_RIDGE)}) r(j)),
{_least_squares("xs", list(_RIDGE), "ly", "ts0_")},
dev AS (SELECT country, sqrt(sum(res * res) / nullif(count(*) - 1, 0)) AS sigma FROM ts0_ WHERE probe = 0 AND use GROUP BY country),
ts AS (SELECT a.country, a.ds, a.is_forecast, ln(1 + a.y) AS log_y, b.fitted AS trend, a.fitted - b.fitted AS yearly, sigma
       FROM ts0_ a JOIN ts0_ b ON a.probe = 0 AND b.probe = 1 AND b.country = a.country AND b.ds = a.ds AND b.is_forecast = a.is_forecast JOIN dev ON dev.country = a.country)"""
_TS_COLS = ["log_y", "trend", "yearly", "yhat", "yhat_lower", "yhat_upper"]


@register("forecast_trend_season_many", Q.with_tagged("""
SELECT country, ds, is_forecast, round(log_y, 6) AS log_y, round(trend, 6) AS trend, round(yearly, 6) AS yearly, round(trend + yearly, 6) AS yhat,
       round(trend + yearly - 1.959963984540054 * sigma, 6) AS yhat_lower, round(trend + yearly + 1.959963984540054 * sigma, 6) AS yhat_upper FROM ts""", PA, _SEASON))
def q_forecast_trend_season_many(spark, sf):
    """Piecewise trend + yearly waves per nation, history and 5 year-end forecasts, all on the log scale."""
    s = _series(spark, sf)
    r = SE.trend_season(s, SE.future_spine(s, "country"), "country")
    return r.select("country", "ds", "is_forecast", *[F.round(c, 6).alias(c) for c in _TS_COLS])


@register("seasonal_components", Q.with_tagged(
    "SELECT country, ds, round(trend, 6) AS trend, round(yearly, 6) AS yearly, is_forecast FROM ts", PA, _SEASON))
def q_seasonal_components(spark, sf):
    """Trend and seasonal component columns of G2."""
    return q_forecast_trend_season_many(spark, sf).select("country", "ds", "trend", "yearly", "is_forecast")


@register("dml_effect")
def q_dml_effect(spark, sf):
    """Cross-fitted effect of the post-policy flag on log amount."""
    return MD.dml_effect(feat(spark, sf))


@register("dml_residual_effect", Q.with_features("""
SELECT round(theta, 9) AS effect_log, round(sqrt(sum(power(rt * (ry - theta * rt), 2))) / stt, 9) AS stderr, count(*) AS n
FROM (SELECT *, sum(rt * ry) OVER () / sum(rt * rt) OVER () AS theta, sum(rt * rt) OVER () AS stt FROM
  (SELECT f.log_amount - o.y AS ry, f.post_policy - o.t AS rt FROM feat f JOIN
    (SELECT k.fold, sector, region, avg(log_amount) AS y, avg(post_policy) AS t FROM feat, (VALUES (0), (1)) k(fold)
     WHERE deal_id % 2 <> k.fold GROUP BY ALL) o
   ON o.fold = f.deal_id % 2 AND o.sector = f.sector AND o.region = f.region))
GROUP BY theta, stt"""))
def q_dml_residual_effect(spark, sf):
    """G5 with group means as nuisances: out-of-fold sector and region means, then the same final stage."""
    f = feat(spark, sf).select("deal_id", "sector", "region", "log_amount", "post_policy").withColumn("fold", (F.col("deal_id") % 2).cast("int"))
    means = f.groupBy(F.lit(1) - F.col("fold"), "sector", "region").agg(F.avg("log_amount").alias("y"), F.avg("post_policy").alias("t")) \
        .toDF("fold", "sector", "region", "y", "t")
    r = f.join(means, ["fold", "sector", "region"]).select((F.col("log_amount") - F.col("y")).alias("ry"), (F.col("post_policy") - F.col("t")).alias("rt"))
    return MD.residual_effect(r).select(F.round("effect_log", 9).alias("effect_log"), F.round("stderr", 9).alias("stderr"), "n")


@register("mape", Q.with_features("""
SELECT phase, round(avg(abs(exp(log_amount) - greatest(exp(sector_blend), 0.1)) / greatest(exp(log_amount), 1.0)) * 100, 6) AS mape
FROM feat GROUP BY phase"""))
def q_mape(spark, sf):
    """M7 (MAPE on the original scale) of the group-mean baseline, per phase."""
    return _r(P.regression_metrics(feat(spark, sf), "log_amount", "sector_blend", ["phase"]).select("phase", "mape"))


@register("rmse_log", Q.with_features(
    "SELECT phase, round(sqrt(avg(power(log_amount - sector_blend, 2))), 6) AS rmse_log FROM feat GROUP BY phase"))
def q_rmse_log(spark, sf):
    """M7 (RMSE on the log scale) of the group-mean baseline, per phase."""
    return _r(P.regression_metrics(feat(spark, sf), "log_amount", "sector_blend", ["phase"]).select("phase", "rmse_log"))


@register("accuracy", f"""WITH {_LAB}
SELECT round(avg(CASE WHEN (score > 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM lab""")
def q_accuracy(spark, sf):
    """M9: share of correct predictions at the 0.5 threshold."""
    d = _lab(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return P.accuracy(d, "quality", "pred").select(F.round("accuracy", 9).alias("accuracy"))
