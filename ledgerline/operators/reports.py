"""Grouped reports (A1-A20), joins (J1-J4), report windows (W6-W11), top-k
and set operations (U1-U5) over the feature table.

Money sums are exact: amounts are summed as DECIMAL(28,6) and cast back to double.
Phase membership uses one range join to the fixed phase dimension (a few rows,
broadcast) instead of one filtered scan per phase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HHI_BAND_LABELS, HHI_BANDS, MONTH_NAMES, Preset
from ..functions import scalar as S
from .common import scalars
from .ordered import exact_quantiles, numbered


def money_sum(col: str = "amount", alias: str = "total"):
    return F.sum(F.col(col).cast("decimal(28,6)")).cast("double").alias(alias)


def phases_frame(spark: SparkSession, preset: Preset) -> DataFrame:
    """The phase dimension (label, lo, hi, ord): fixed size, from the preset."""
    rows = [(p.label, p.lo, p.hi if p.hi is not None else 1 << 30, i + 1) for i, p in enumerate(preset.phases)]
    return spark.createDataFrame(rows, "label string, lo int, hi int, ord int")


def phase_range_join(df: DataFrame, preset: Preset, how: str = "inner") -> DataFrame:
    """Rows x phases on lo <= year <= hi (broadcast nested-loop join against the
    fixed phase rows; a row may fall in several overlapping phases)."""
    ph = F.broadcast(phases_frame(df.sparkSession, preset)).alias("ph")
    return (df.join(ph, (F.col("year") >= F.col("ph.lo")) & (F.col("year") <= F.col("ph.hi")), how)
            .withColumnRenamed("label", "phase_label").drop("lo", "hi"))


# ---------------------------------------------------------------- aggregations
def year_total(f: DataFrame) -> DataFrame:
    """A1"""
    return f.groupBy("year").agg(money_sum())


def investor_counts_by_phase(f: DataFrame, preset: Preset, top: int | None = None) -> DataFrame:
    """Deals per investor per phase, top ``n`` per phase (count desc,
    investor asc on ties) plus min/max count over all kept rows (shared scale)."""
    top = top or preset.top_investors
    c = phase_range_join(f.select("year", "investor"), preset).groupBy("phase_label", "investor").agg(
        F.count(F.lit(1)).alias("n"))
    r = c.withColumn("rank", F.row_number().over(
        Window.partitionBy("phase_label").orderBy(F.desc("n"), F.asc("investor")))).where(F.col("rank") <= top)
    kept = Window.partitionBy(F.lit(0))  # at most n rows a phase
    return (r.withColumn("global_min", F.min("n").over(kept)).withColumn("global_max", F.max("n").over(kept))
            .withColumnRenamed("phase_label", "phase").withColumn("rank", F.col("rank").cast("int")))


def sector_total_by_phase(f: DataFrame, preset: Preset) -> DataFrame:
    """A3"""
    return (phase_range_join(f.select("year", "sector", "amount"), preset)
            .groupBy(F.col("phase_label").alias("phase"), "sector").agg(money_sum()))


def greenfield_split_by_phase(f: DataFrame, preset: Preset) -> DataFrame:
    """A4: greenfield vs other sums per phase; total, greenfield percent, total in
    thousands and its money label; phases with total 0 are dropped."""
    g = (phase_range_join(f.select("year", "deal_type", "amount"), preset)
         .groupBy(F.col("phase_label").alias("phase"))
         .agg(F.sum(F.when(F.col("deal_type") == "Greenfield", F.col("amount").cast("decimal(28,6)"))
                    .otherwise(F.lit(0).cast("decimal(28,6)"))).cast("double").alias("greenfield"),
              F.sum(F.when(F.col("deal_type") == "M&A", F.col("amount").cast("decimal(28,6)"))
                    .otherwise(F.lit(0).cast("decimal(28,6)"))).cast("double").alias("other")))
    g = g.withColumn("total", F.col("greenfield") + F.col("other")).where(F.col("total") != 0)
    return g.select("phase", "greenfield", "other", "total",
                    F.round(100 * F.col("greenfield") / F.col("total"), 6).alias("greenfield_pct"),
                    F.round(F.col("total") / 1000, 6).alias("total_thousands"))


def country_total_by_phase(f: DataFrame, preset: Preset) -> DataFrame:
    """A5 (country names mapped by F16)."""
    return (phase_range_join(f.select("year", S.map_country("country").alias("country_mapped"), "amount"), preset)
            .groupBy(F.col("phase_label").alias("phase"), "country_mapped").agg(money_sum()))


def country_phase_extremes(f: DataFrame, preset: Preset) -> DataFrame:
    """Max over (mapped country x year bin) sums; min over raw amounts."""
    b = (f.select(S.map_country("country").alias("c"), S.bin_year("year", preset).alias("ybin"), "amount")
         .groupBy("c", "ybin").agg(money_sum()))
    mn = scalars(f.agg(F.min("amount").alias("m")))["m"]
    return b.agg(F.max("total").alias("max_bin_total")).withColumn("min_amount", F.lit(mn).cast("double"))


def sector_subsector_rollup(f: DataFrame, preset: Preset) -> DataFrame:
    """Per phase, (sector, subsector) leaves with sum > 0, plus one parent
    row per sector whose value is the sum of its kept leaves (rollup over the
    leaf aggregate; grouping_id picks the two levels)."""
    leaves = (phase_range_join(f.select("year", "sector", "subsector", "amount"), preset)
              .groupBy(F.col("phase_label").alias("phase"), "sector", "subsector")
              .agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("v"))
              .where(F.col("v") > 0))
    r = (leaves.rollup("phase", "sector", "subsector").agg(F.sum("v").cast("double").alias("value"),
                                                           F.grouping_id().alias("gid"))
         .where(F.col("gid").isin(0, 1)))
    return r.select("phase",
                    F.when(F.col("gid") == 0, F.col("subsector")).otherwise(F.col("sector")).alias("label"),
                    F.when(F.col("gid") == 0, F.col("sector")).otherwise(F.lit("")).alias("parent"),
                    "value", F.when(F.col("gid") == 0, "leaf").otherwise("parent").alias("node"))


def top_groups(f: DataFrame, col: str, n: int) -> DataFrame:
    """L3: the ``n`` groups with the largest money total (ties by name)."""
    return f.groupBy(col).agg(money_sum()).orderBy(F.desc("total"), F.asc(col)).limit(n)


def region_year_pivot(f: DataFrame, preset: Preset) -> DataFrame:
    """Top regions by total (a bounded list of names reaches the driver to
    name the pivot columns), year x region sums, missing cells 0."""
    top = [r[0] for r in top_groups(f, "region", preset.top_regions).select("region").collect()]
    kept = f.join(F.broadcast(f.sparkSession.createDataFrame([(t,) for t in top], "region string")),
                  "region", "left_semi")
    p = (kept.select("year", "region", F.col("amount").cast("decimal(28,6)").alias("a"))
         .groupBy("year").pivot("region", sorted(top)).agg(F.sum("a").cast("double")))
    return p.fillna(0.0)


def sector_hhi_by_phase(f: DataFrame, preset: Preset) -> DataFrame:
    """HHI = sum over sectors of (100 * sector share)^2 per phase; 0 for
    an empty or zero-total phase (phase dimension left-joined); bands by fixed cuts."""
    spark = f.sparkSession
    st = (phase_range_join(f.select("year", "sector", "amount"), preset)
          .groupBy("phase_label", "sector").agg(money_sum("amount", "st")))
    sh = st.withColumn("share", 100 * F.col("st") / F.sum("st").over(Window.partitionBy("phase_label")))
    h = sh.groupBy("phase_label").agg(F.sum(F.pow("share", 2)).alias("hhi"), F.sum("st").alias("tot"))
    ph = phases_frame(spark, preset).select(F.col("label").alias("phase_label"), "ord")
    out = ph.join(h, "phase_label", "left").select(
        F.col("phase_label").alias("phase"),
        F.round(F.when(F.col("tot") > 0, F.col("hhi")).otherwise(F.lit(0.0)), 6).alias("hhi"))
    lo, hi = HHI_BANDS
    return out.withColumn("band", F.when(F.col("hhi") < lo, HHI_BAND_LABELS[0])
                          .when(F.col("hhi") < hi, HHI_BAND_LABELS[1]).otherwise(HHI_BAND_LABELS[2]))


def share_bin_totals(f: DataFrame, preset: Preset) -> DataFrame:
    """A10: amount per share bin per phase incl. empty bins as 0, and percent of the
    phase total over binned rows (the bins x phases spine is fixed: 5 x #phases)."""
    spark = f.sparkSession
    bins = ["0-19", "20-39", "40-59", "60-79", "80-99"]
    spine = spark.createDataFrame([(p.label, b) for p in preset.phases for b in bins], "phase string, bin string")
    a = (phase_range_join(f.select("year", S.share_bin(F.col("share_size").cast("double"), preset).alias("bin"),
                                   "amount").where(F.col("bin").isNotNull()), preset)
         .groupBy(F.col("phase_label").alias("phase"), "bin").agg(money_sum()))
    j = F.broadcast(spine).join(a, ["phase", "bin"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    pt = F.sum("total").over(Window.partitionBy("phase"))
    return j.withColumn("pct", F.when(pt > 0, F.round(100 * F.col("total") / pt, 6)))


def group_means(f: DataFrame, group: str, value: str = "amount") -> DataFrame:
    """A11"""
    return f.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def describe_numeric(f: DataFrame, cols: list[str]) -> DataFrame:
    """A12 (numeric part): count, mean, std (ddof 1), min, 25/50/75 %, max for every
    column, in one pass over the rows unpivoted to (column, value) + the exact
    quantile operator keyed by column."""
    long = f.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "x")
    base = long.groupBy("column_name").agg(
        F.count("x").alias("count"), F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = exact_quantiles(long, ["column_name"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    q = q.select("column_name", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])
    return base.join(q, "column_name", "left")


def describe_categorical(f: DataFrame, cols: list[str]) -> DataFrame:
    """A12 (text part): count, unique, top (most frequent; smallest on ties), freq."""
    long = f.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "v")
    vc = long.where(F.col("v").isNotNull()).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
    return vc.groupBy("column_name").agg(
        F.sum("c").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct((-F.col("c")).alias("nc"), F.col("v").alias("vv"))).alias("top"),
        F.max("c").alias("freq"))


def share_shift(f: DataFrame, group: str = "sector") -> DataFrame:
    """A13 (D1 fixed): share of each group within the pre and the post period, and
    the change in points."""
    s = f.groupBy(group).agg(
        F.sum(F.when(F.col("post_policy") == 0, F.col("amount").cast("decimal(28,6)"))).cast("double").alias("pre"),
        F.sum(F.when(F.col("post_policy") == 1, F.col("amount").cast("decimal(28,6)"))).cast("double").alias("post"))
    s = s.fillna(0.0, ["pre", "post"])
    w = Window.partitionBy()
    s = s.select(group, (100 * F.col("pre") / F.sum("pre").over(w)).alias("pre_share"),
                 (100 * F.col("post") / F.sum("post").over(w)).alias("post_share"))
    return s.select(group, F.round("pre_share", 6).alias("pre_share"), F.round("post_share", 6).alias("post_share"),
                    F.round(F.col("post_share") - F.col("pre_share"), 6).alias("change"))


def top_bottom_shift(f: DataFrame, n: int = 7, group: str = "sector") -> DataFrame:
    """The ``n`` largest and ``n`` smallest changes, union, de-duplicated."""
    s = share_shift(f, group)
    hi = s.withColumn("r", F.row_number().over(Window.orderBy(F.desc("change"), group))).where(F.col("r") <= n)
    lo = s.withColumn("r", F.row_number().over(Window.orderBy(F.asc("change"), group))).where(F.col("r") <= n)
    return hi.drop("r").unionByName(lo.drop("r")).dropDuplicates([group])


def year_type_pivot(f: DataFrame) -> DataFrame:
    """Year x deal type money sums, 0-filled (the two type labels are fixed)."""
    return (f.select("year", "deal_type", F.col("amount").cast("decimal(28,6)").alias("a"))
            .groupBy("year").pivot("deal_type", ["Greenfield", "M&A"]).agg(F.sum("a").cast("double"))
            .fillna(0.0))


def count_by_year_share(f: DataFrame) -> DataFrame:
    """Deals per year and the share of all deals (ratio on the aggregate)."""
    c = f.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("proportion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def phase_bin_share_r(deals_r: DataFrame, preset: Preset) -> DataFrame:
    """A16/F24 (R rules): phase flags unpivoted, rows with flag 1 and a bin kept, sum
    by (phase, bin), proportion inside the phase."""
    d = deals_r.select("amount", S.bin_share_r(F.col("share_size").cast("double")).alias("bin"),
                       *[F.col("year").between(p.lo, p.hi).cast("int").alias(p.label) for p in preset.phases])
    labels = [p.label for p in preset.phases]
    long = (d.where(F.col("bin").isNotNull())
            .unpivot(["amount", "bin"], [F.col(f"`{lb}`") for lb in labels], "phase", "flag").where("flag = 1"))
    g = long.groupBy("phase", "bin").agg(money_sum("amount", "amount_sum"))
    g = g.withColumn("proportion", F.round(F.col("amount_sum") / F.sum("amount_sum").over(Window.partitionBy("phase")), 6))
    return g.withColumn("phase", S.phase_label_text_r2("phase"))


def target_balance(f: DataFrame) -> DataFrame:
    """Percent of high-value deals and the exact median amount."""
    med = scalars(exact_quantiles(f, [], "amount", {"m": 0.5}))["m"]
    return f.agg(F.round(F.avg("high_value") * 100, 6).alias("pct_high")).withColumn(
        "median_amount", F.round(F.lit(med).cast("double"), 6))


def exact_quantile_report(f: DataFrame) -> DataFrame:
    """Per-year 0.70 and 0.50 quantiles and the global ones (year NULL), selected together."""
    both = f.select(F.explode(F.array(F.struct(F.lit(0).alias("all"), F.col("year").alias("y")), F.struct(F.lit(1).alias("all"), F.lit(0).alias("y")))).alias("g"),
                    "amount").select("g.all", "g.y", "amount")
    q = exact_quantiles(both, ["all", "y"], "amount", {"q50": 0.5, "q70": 0.7})
    return q.select(F.when(F.col("all") == 0, F.col("y")).cast("int").alias("year"), F.round("q50", 6).alias("q50"), F.round("q70", 6).alias("q70"))


def distinct_levels(f: DataFrame, cols: list[str]) -> DataFrame:
    """Number of distinct values per column (exact)."""
    return f.select(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def year_range(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows before/after cleaning, rows removed, min/max year kept."""
    n_in = scalars(raw.agg(F.count(F.lit(1)).alias("n")))["n"]
    b = cleaned.agg(F.count(F.lit(1)).alias("rows_out"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    return b.withColumn("rows_in", F.lit(n_in).cast("bigint")).withColumn("rows_removed",
                                                                         F.col("rows_in") - F.col("rows_out"))


# ---------------------------------------------------------------- joins
def left_join_country_totals(f: DataFrame, nation: DataFrame, preset: Preset) -> DataFrame:
    """J1 (D8 fixed: both sides mapped to one key): every dimension country, per
    phase, with its total or NULL ("no data"). The dimension is expanded by the
    fixed phase labels (a generator, no join) and left-joined to the totals once."""
    labels = F.array(*[F.lit(p.label) for p in preset.phases])
    grid = nation.select(S.map_country("n_name").alias("country_mapped")).distinct().select(
        "country_mapped", F.explode(labels).alias("phase"))
    return grid.join(country_total_by_phase(f, preset), ["country_mapped", "phase"], "left")


def group_stat_join_back(f: DataFrame, group: str = "sector", value: str = "amount") -> DataFrame:
    """Each row with its group's mean (aggregate joined back by key)."""
    m = f.groupBy(group).agg(F.avg(value).alias("group_mean"))
    return f.select("deal_id", group, value).join(m, group, "left").withColumn(
        "group_mean", F.round("group_mean", 6))


def top_n_with_ties(f: DataFrame, col: str, n: int) -> DataFrame:
    """Groups whose count ranks <= n, ties kept (rank on the aggregate)."""
    c = f.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n")))).where(F.col("rank") <= n) \
        .withColumn("rank", F.col("rank").cast("int"))


def semi_join_top(f: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose ``col`` is among the top ``n`` by count (ties kept)."""
    top = top_n_with_ties(f, col, n).select(col)
    return f.select("deal_id", col, "amount").join(top, col, "left_semi")


# ---------------------------------------------------------------- windows
def share_of_total(f: DataFrame, group: str = "sector") -> DataFrame:
    """W6"""
    g = f.groupBy(group).agg(money_sum())
    return g.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


def top5_per_group(f: DataFrame, group: str, value: str = "amount", n: int = 5) -> DataFrame:
    """The ``n`` largest values per group (deal id breaks ties). The
    ``row_number() <= n`` filter lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot group ships at most n rows per map task."""
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc("deal_id"))
    return (f.select(group, "deal_id", value).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("int")))


def donut_label_position(f: DataFrame) -> DataFrame:
    """Yearly totals and each slice's stacked mid position."""
    g = f.groupBy("year").agg(money_sum())
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("position", F.round(F.sum("total").over(w) - F.col("total") / 2, 6))


def category_code_table(f: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level, code) for each coded column; codes by the levels' sorted order."""
    levels = f.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "level") \
        .where(F.col("level").isNotNull()).distinct()
    return numbered(levels, ["column_name"], ["level"], "code").withColumn("code", F.col("code").cast("int"))


# ---------------------------------------------------------------- sorts / sets
def row_positions(f: DataFrame) -> DataFrame:
    """L1: global position (1-based) of each deal in (year, deal_id) order by a prefix scan over range partitions."""
    return numbered(f.select("deal_id", "year"), [], ["year", "deal_id"], "position").select(
        "deal_id", "year", (F.col("position") + 1).alias("position"))


def calendar_order(f: DataFrame) -> DataFrame:
    """Month names present in the data, in calendar order (intersection of
    the fixed calendar with the observed levels)."""
    present = f.select(S.month_name("month").alias("month_name")).distinct()
    cal = f.sparkSession.createDataFrame([(m,) for m in MONTH_NAMES], "month_name string")
    return cal.intersect(present).select("month_name", S.calendar_position("month_name").cast("int").alias("position"))


def level_table(f: DataFrame, col: str) -> DataFrame:
    """(col, level): 0-based position of each distinct value in sorted order; stays a DataFrame however many there are."""
    return numbered(f.select(col).where(F.col(col).isNotNull()).distinct(), [], [col], "level").withColumn("level", F.col("level").cast("int"))


def dummy_encode(f: DataFrame, col: str, keep: list[str], most: int = 1000) -> DataFrame:
    """One 0/1 column per level of ``col`` except the first (sorted), beside
    the kept columns. Only the names of at most ``most`` levels reach the driver to
    name the columns; a wider domain is an error (use dummy_encode_long)."""
    levels = [r[0] for r in f.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{col} has more than {most} levels; use dummy_encode_long")
    return f.select(*keep, *[(F.col(col) == lv).cast("int").alias(f"{col}_{lv}") for lv in levels[1:]])


def dummy_encode_long(f: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """F25/U3 for wide domains: the kept columns and ``level``, the index of the row's only non-zero dummy (NULL for the
    first level or a missing value), by a join with the level table."""
    return f.join(level_table(f, col), col, "left").select(*keep, F.when(F.col("level") > 0, F.col("level")).alias("level"))


def phase_summary(f: DataFrame) -> DataFrame:
    """One grouped pass instead of a per-phase loop + append."""
    return f.groupBy("phase").agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.avg("log_amount"), 6).alias("mean_log"),
                                  money_sum())
