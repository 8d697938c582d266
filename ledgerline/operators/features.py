"""The feature table: typed deals + tags + ordered, group and target features.

Built once per (session, data, preset) and written to the shared folder; every
report reads it (column pruning + year-partition pruning apply to that read).

The tagged rows are range partitioned by deal order and written once; these rows
are then shuffled by block for the chunked rolling windows and the running count, and
the small tables are joined to what comes out, on its way to the final write.
Side passes read a few narrow columns of the written rows: global/per-year exact
quantiles, one GROUPING SETS aggregation for all per-category means and level sets,
and the chunk tails. Their small results are written, and joined back (Spark
broadcasts them as their files are small) or folded in as literals.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Preset
from ..functions import scalar as S
from ..session import shared_dir
from .clean import clean_rows, with_optional
from .common import scalars
from .ordered import exact_quantiles, in_order, ordered_features, written

CATEGORY_COLUMNS = ["sector", "region", "investor", "deal_type", "phase", "subsector", "country"]
CODED_COLUMNS = ["sector", "region", "deal_type", "phase", "subsector"]

_MATERIALISED: dict[tuple, str] = {}


def tag(df: DataFrame, preset: Preset) -> DataFrame:
    """Row-local tags: log amount, policy flag, phase, deal type, cleaned categories,
    phase flags and the policy interaction."""
    df = with_optional(df, "greenfield")
    d = df.select(
        "*",
        S.log_amount("amount").alias("log_amount"),
        S.post_policy_flag("year", preset.policy_year).alias("post_policy"),
        S.assign_phase("year", preset).alias("phase"),
        S.is_greenfield("greenfield").alias("deal_type"),
    )
    for c in CATEGORY_COLUMNS:
        d = d.withColumn(c, S.clean_category(c, preset.missing_label))
    return d.select("*", *S.phase_flags("year", preset),
                    (F.col("post_policy") * F.col("year")).alias("policy_interaction"))


def category_summaries(t: DataFrame, cols: list[str], value: str) -> DataFrame:
    """One pass (GROUPING SETS) over the rows: per level of each column, and over
    all rows, the mean, sum and count of ``value``. Output (column_name, level, mean, total, n, code) with
    column_name NULL for the all-rows set and code the level's place in its column; one row per level (small)."""
    g = t.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"),
        F.grouping_id().alias("_gid"))
    n = len(cols)
    name = F.lit(None).cast("string")
    level = F.lit(None).cast("string")
    for i, c in enumerate(cols):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))   # only column i grouped
        name = F.when(F.col("_gid") == gid, F.lit(c)).otherwise(name)
        level = F.when(F.col("_gid") == gid, F.col(c).cast("string")).otherwise(level)
    code = F.dense_rank().over(Window.partitionBy("column_name").orderBy("level")) - 1
    return g.select(name.alias("column_name"), level.alias("level"), "mean", "total", "n").withColumn("code", code.cast("int"))


def build_features(deals: DataFrame, preset: Preset) -> DataFrame:
    """Lazy plan of the whole feature table (see module docstring). The small
    tables are derived from the tagged rows ``t`` in deal order (global + per-year
    exact quantiles on one stacked stream; all per-category means and level sets in
    one GROUPING SETS aggregation) and joined onto ``t`` once each."""
    t = in_order(clean_rows(deals, preset), ["year", "deal_id"], lambda d: tag(d, preset))
    stacked = t.select(F.col("year").cast("long").alias("_k"), "amount").unionByName(
        t.select(F.lit(-1).cast("long").alias("_k"), "amount"))
    # small tables (one row per year / per level): written before the wide plan is made, so the sizes of their files are known
    # when its joins are planned. A side whose size is only known as it runs may come too late: the rows are then shuffled
    # by a category or year, a task per level. The two side passes are independent jobs and are submitted concurrently.
    cols = list(dict.fromkeys(["sector", "region"] + CODED_COLUMNS))
    with ThreadPoolExecutor(2) as ex:
        f_qq = ex.submit(lambda: written(exact_quantiles(stacked, ["_k"], "amount", {"_med": 0.5, "_q70": 0.7}), "quantiles"))
        f_cs = ex.submit(lambda: written(category_summaries(t, cols, "log_amount"), "levels"))
        qq, cs = f_qq.result(), f_cs.result()
    gq = scalars(qq.where("_k = -1").select("_med", "_q70"))                         # two numbers
    yq = qq.where("_k <> -1").select(F.col("_k").cast("int").alias("year"), F.col("_q70").alias("_qy"))
    gl = scalars(cs.where(F.col("column_name").isNull()).select("mean", "total", "n"))  # three numbers
    glob = gl["mean"]
    rolled = ordered_features(t, "sector", "amount", "post_policy", (2, 3), preset.rows_per_block)
    d = (rolled.withColumn("_med", F.lit(gq["_med"]).cast("double")).withColumn("_q70", F.lit(gq["_q70"]).cast("double"))
         .withColumn("_glob", F.lit(glob).cast("double")).join(yq, "year", "left"))
    made = [c for c in rolled.columns if c not in t.columns]
    for c in CODED_COLUMNS:
        lv = cs.where(F.col("column_name") == c).select(F.col("level").alias(c), F.col("code").alias(f"{c}_code"), *(
            F.col(v).alias(f"_{c[0]}{v[0]}") for v in ("mean", "total", "n") if c in ("sector", "region")))
        d = d.join(lv, c, "left")
    return d.select(
        *[c for c in d.columns if not c.startswith("_") and c not in made],
        (F.col("amount") > F.col("_med")).cast("int").alias("high_value"),
        (F.col("amount") > F.col("_q70")).cast("int").alias("high_value_70"),
        (F.col("amount") > F.col("_qy")).cast("int").alias("adaptive_target"),
        (0.7 * F.col("_sm") + 0.3 * F.col("_glob")).alias("sector_blend"),
        (0.7 * F.col("_rm") + 0.3 * F.col("_glob")).alias("region_blend"),
        # leave-one-out versions (the row's own value excluded from both means; D11)
        (0.7 * (F.col("_st") - F.col("log_amount")) / F.when(F.col("_sn") > 1, F.col("_sn") - 1)
         + 0.3 * (F.lit(gl["total"]) - F.col("log_amount")) / F.lit(max(gl["n"] - 1, 1))).alias("sector_blend_loo"),
        (0.7 * (F.col("_rt") - F.col("log_amount")) / F.when(F.col("_rn") > 1, F.col("_rn") - 1)
         + 0.3 * (F.lit(gl["total"]) - F.col("log_amount")) / F.lit(max(gl["n"] - 1, 1))).alias("region_blend_loo"),
        (F.col("sector_code") * F.col("year")).alias("sector_year_int"),
        (F.col("region_code") * F.col("post_policy")).alias("region_policy_int"),
        *made,
    )


def features(spark: SparkSession, sf_dir: str, preset: Preset) -> DataFrame:
    """Materialised feature table for ``sf_dir`` (written once per session)."""
    from ..sources.deals import deals as deals_table

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), preset.name)
    path = _MATERIALISED.get(key)
    if path is None:
        path = f"{shared_dir(spark)}/features-{preset.name}-{abs(hash(key)) % 10**10}"
        build_features(deals_table(spark, sf_dir), preset).write.mode("overwrite").partitionBy("year").parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)
