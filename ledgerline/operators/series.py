"""Many-series jobs (G1-G3, G6): one short monthly series per key, everything as grouped aggregates.

Spark aggregates rows to one value per (key, month), fills the gaps of every series, and fits all series at once: a
least-squares model is a table of sums of products per key (:func:`gram`), solved row by row with array functions
(:func:`solved`). A series has one row per month, so windows inside a key are bounded by the calendar, not by the data.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: G1: lags of the long autoregression that gives the innovations, and the bound kept from a unit root in forecasts.
LONG_LAGS, ROOT_BOUND = 6, 0.99
#: Slope changes, spread over the first 80 % of a series, pairs of yearly waves, and the ridge on either.
CHANGES, WAVES, CHANGE_RIDGE, WAVE_RIDGE = 6, 3, 1.0, 0.1

Z95 = 1.959963984540054


def monthly_series(df: DataFrame, key: str, value: str = "amount") -> DataFrame:
    """(key, ds = first day of month, y = money total) from the deal rows."""
    return (df.groupBy(key, F.make_date("year", "month", F.lit(1)).alias("ds"))
            .agg(F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("y")))


def filled(series: DataFrame, key: str) -> DataFrame:
    """Every month from a series' first to its last, months without rows with total 0: key, ds, t (0, 1, ...), y and
    ly = ln(1 + y), which is defined for empty months too."""
    span = series.groupBy(key).agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    months = span.select(key, "first", F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("ds"))
    y = F.coalesce("y", F.lit(0.0))
    return months.join(series.select(key, "ds", "y"), [key, "ds"], "left").select(
        key, "ds", _month_steps("first", "ds").alias("t"), y.alias("y"), F.log1p(y).alias("ly"))


def _month_steps(start: str, end: str):
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("int")


def future_spine(series: DataFrame, key: str, periods: int = 5) -> DataFrame:
    """The next ``periods`` year-end dates after each series' last date."""
    last = series.groupBy(key).agg(F.max("ds").alias("last"))
    y0 = F.when(F.col("last") >= F.make_date(F.year("last"), F.lit(12), F.lit(31)), F.year("last") + 1) \
        .otherwise(F.year("last"))
    return last.select(key, F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("step"), y0.alias("y0")) \
        .select(key, (F.col("step") + 1).alias("step"), F.make_date(F.col("y0") + F.col("step"), F.lit(12),
                                                                    F.lit(31)).alias("ds"))


# ---------------------------------------------------------------- least squares by key
def gram(rows: DataFrame, key: str, xs: list[Column], y: Column) -> DataFrame:
    """Per key: n, yy, and ``m``, the normal equations as rows [x_i x_1, ..., x_i x_p, x_i y], all summed in one aggregation."""
    p, d = len(xs), rows.select(key, *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)], y.cast("double").alias("y"))
    sums = {(i, j): F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)}
    s = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"),
                           *sums.values(), *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(p)])
    m = F.array(*[F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for j in range(p)], F.col(f"b{i}")) for i in range(p)])
    return s.select(key, "n", "yy", m.alias("m"))


def solved(m: Column, p: int, ridge: list[float] | None = None) -> Column:
    """Coefficients of the normal equations ``m`` (plus ``ridge`` on the diagonal) as an array, by elimination on the
    symmetric positive matrix; NULL if a pivot is below 1e-9 of its diagonal (constant or too short series)."""
    if ridge:
        add = F.array(*[F.lit(float(r)) for r in ridge])
        m = F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, x + F.get(add, i)).otherwise(x)))
    diagonal = F.transform(m, lambda row, i: F.get(row, i))

    def eliminate(state: Column, k: Column) -> Column:
        pivot = F.get(state, k)
        by = F.when(F.get(pivot, k) > 1e-9 * F.get(diagonal, k), F.get(pivot, k))
        return F.transform(state, lambda row, i: F.when(i == k, F.transform(row, lambda x: x / by)).otherwise(
            F.zip_with(row, pivot, lambda x, y: x - y * F.get(row, k) / by)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), m, eliminate)
    beta = F.transform(done, lambda row: F.get(row, F.lit(p)))
    return F.when(F.forall(beta, lambda x: x.isNotNull()), beta)


def differences(series: DataFrame, key: str, lags: int = LONG_LAGS) -> DataFrame:
    """``filled`` with d, the monthly difference of ly, and d1, d2, ... the ones before."""
    w = Window.partitionBy(key).orderBy("ds")
    d = filled(series, key).withColumn("d", F.col("ly") - F.lag("ly").over(w))
    return d.select("*", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)])


def arima_fit(series: DataFrame, key: str, lags: int = LONG_LAGS) -> DataFrame:
    """G1 (fit): ARIMA(1,1,1) of ly by two regressions (Hannan and Rissanen): a long autoregression of the differences gives
    the innovations, and the differences are regressed on the difference and the innovation before.

    phi, theta, const, sigma2 (SSE / (n - 3)), n, aic, last value and last difference. Series too short or constant have a
    NULL fit, they are not dropped."""
    d = differences(series, key, lags)
    long = [F.lit(1.0), *[F.col(f"d{k}") for k in range(1, lags + 1)]]
    ar = gram(d.where(F.col(f"d{lags}").isNotNull()), key, long, F.col("d")).where(F.col("n") > lags + 1) \
        .select(key, solved(F.col("m"), lags + 1).alias("a"))
    e = F.col("d") - sum(F.get("a", F.lit(k)) * x for k, x in enumerate(long))
    w = Window.partitionBy(key).orderBy("ds")
    before = d.join(ar, key).withColumn("e", e).withColumn("e1", F.lag("e").over(w)).where(F.col("e1").isNotNull())
    g = gram(before, key, [F.lit(1.0), F.col("d1"), F.col("e1")], F.col("d")).where("n > 3").withColumn("b", solved(F.col("m"), 3))
    sse = F.greatest(F.col("yy") - sum(F.get("b", F.lit(k)) * F.get(F.get("m", F.lit(k)), F.lit(3)) for k in range(3)), F.lit(0.0))
    fit = g.where("b is not null").withColumn("sse", sse)
    ends = d.groupBy(key).agg(F.max_by("ly", "ds").alias("last_ly"), F.max_by("d", "ds").alias("last_d"))
    return ends.join(fit, key, "left").select(
        key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.get("b", F.lit(1)).alias("phi"), F.get("b", F.lit(2)).alias("theta"),
        F.get("b", F.lit(0)).alias("const"), (F.col("sse") / (F.col("n") - 3)).alias("sigma2"),
        F.when(F.col("sse") > 0, F.col("n") * F.log(F.col("sse") / F.col("n")) + 6).alias("aic"), "last_ly", "last_d")


def forecast_arima_many(series: DataFrame, key: str, steps: int = 5, lags: int = LONG_LAGS) -> DataFrame:
    """G1: the next ``steps`` months of every series with a 95% interval, in closed form.

    The last innovation is the sum of (-theta)^k (d - const - phi d1) over the months k before the last. With mu the mean
    difference and f = const + phi last_d + theta last_e the next one, the h-th value is last + h mu + (f - mu)
    (1 - phi^h) / (1 - phi), and its variance sigma2 times the sum of squared cumulated weights 1 + (phi + theta)
    (1 - phi^j) / (1 - phi). phi and theta are kept inside +-ROOT_BOUND."""
    inside = lambda c: F.greatest(F.least(F.col(c), F.lit(ROOT_BOUND)), F.lit(-ROOT_BOUND))
    fit = arima_fit(series, key, lags).withColumns({"phi": inside("phi"), "theta": inside("theta")})
    d = differences(series, key, lags).where("d1 is not null").select(key, "t", "d", "d1")
    last = d.groupBy(key).agg(F.max("t").alias("last_t"))
    u = F.pow(-F.col("theta"), (F.col("last_t") - F.col("t")).cast("double")) * (F.col("d") - F.col("const") - F.col("phi") * F.col("d1"))
    innovation = d.join(last, key).join(fit.select(key, "phi", "theta", "const"), key).groupBy(key).agg(F.sum(u).alias("last_e"))
    f = fit.join(innovation, key, "left").select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    phi, h = F.col("phi"), F.col("step")
    mu = F.col("const") / (1 - phi)
    following = F.col("const") + phi * F.col("last_d") + F.col("theta") * F.col("last_e")
    ly = F.col("last_ly") + h * mu + (following - mu) * (1 - F.pow(phi, h)) / (1 - phi)
    weight = lambda j: 1 + (phi + F.col("theta")) * (1 - F.pow(phi, j)) / (1 - phi)
    spread = F.aggregate(F.sequence(F.lit(0), h - 1), F.lit(0.0), lambda acc, j: acc + weight(j) * weight(j))
    half = Z95 * F.sqrt(F.col("sigma2") * spread)
    return f.select(key, "step", ly.alias("log_forecast"), (ly - half).alias("log_lower"), (ly + half).alias("log_upper"),
                    F.expm1(ly).alias("forecast"))


def trend_basis(t: Column, length: Column) -> list[Column]:
    """1, s and max(0, s - c) for each change c, where s runs from 0 to 1 over the series."""
    s = t / F.greatest(length, F.lit(1))
    return [F.lit(1.0), s, *[F.greatest(s - 0.8 * (k + 1) / (CHANGES + 1), F.lit(0.0)) for k in range(CHANGES)]]


def wave_basis(month: Column) -> list[Column]:
    at = 2 * pi / 12 * (month - 1)
    return [wave(k * at) for k in range(1, WAVES + 1) for wave in (F.sin, F.cos)]


def trend_season(series: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """ly = piecewise linear trend + yearly waves, ridge least squares by series, for every month of the series and for
    the spine's dates.

    The trend's slope may change at CHANGES places in the first 80 % of the series; changes and waves are held by a ridge,
    level and slope only by one that keeps a single month solvable. yhat is their sum with a 95% band of the residual
    deviation (NULL for a single month)."""
    m = filled(series, key).withColumn("m", F.month("ds"))
    span = m.groupBy(key).agg(F.max("t").alias("length"), F.min("ds").alias("first"))
    future = spine.join(span, key).select(key, "ds", _month_steps("first", "ds").alias("t"), F.lit(None).cast("double").alias("y"),
                                          F.lit(None).cast("double").alias("ly"), F.month("ds").alias("m"), F.lit(True).alias("is_forecast"))
    points = m.select(key, "ds", "t", "y", "ly", "m", F.lit(False).alias("is_forecast")).unionByName(future).join(span.select(key, "length"), key)
    line, waves = trend_basis(F.col("t"), F.col("length")), wave_basis(F.col("m"))
    p, ridge = len(line) + len(waves), [1e-6, 1e-6] + [CHANGE_RIDGE] * CHANGES + [WAVE_RIDGE] * len(waves)
    g = gram(points.where("not is_forecast"), key, [*line, *waves], F.col("ly")).withColumn("b", solved(F.col("m"), p, ridge))
    sse = F.col("yy") - sum(F.get("b", F.lit(k)) * (F.get(F.get("m", F.lit(k)), F.lit(p)) + ridge[k] * F.get("b", F.lit(k))) for k in range(p))
    fit = g.select(key, "b", F.when(F.col("n") > 1, F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("n") - 1))).alias("sigma"))
    trend = sum(F.get("b", F.lit(k)) * x for k, x in enumerate(line))
    yearly = sum(F.get("b", F.lit(len(line) + k)) * x for k, x in enumerate(waves))
    j = points.join(fit, key).withColumns({"trend": trend, "yearly": yearly})
    yhat, half = F.col("trend") + F.col("yearly"), Z95 * F.col("sigma")
    return j.select(key, "ds", "is_forecast", F.log1p("y").alias("log_y"), "trend", "yearly", yhat.alias("yhat"),
                    (yhat - half).alias("yhat_lower"), (yhat + half).alias("yhat_upper"))
