"""Report, join, window, top-k and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COUNTRY_MAP, MONTH_NAMES, PRESET_A, PRESET_B
from ..operators import reports as R
from ..operators.clean import clean_rows, clean_rows_r
from ..operators.features import features
from ..sources.deals import deals, table
from . import sql as Q
from .registry import register

PA, PB = PRESET_A, PRESET_B
MS = "CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE)"
PH = Q.phases_values(PA)
PJ = "JOIN phases p ON year BETWEEN p.lo AND p.hi"


def feat(spark, sf):
    return features(spark, sf, PA)


def country_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_MAP.items())
    return f"CASE {col} {whens} ELSE {col} END"


def bin_case(col: str) -> str:
    return (f"CASE WHEN {col} >= 0 AND {col} < 20 THEN '0-19' WHEN {col} >= 20 AND {col} < 40 THEN '20-39' "
            f"WHEN {col} >= 40 AND {col} < 60 THEN '40-59' WHEN {col} >= 60 AND {col} < 80 THEN '60-79' "
            f"WHEN {col} >= 80 AND {col} < 100 THEN '80-99' END")


def bin_case_r(col: str) -> str:
    return (f"CASE WHEN {col} <= 19 THEN '0-19' WHEN {col} <= 39 THEN '20-39' WHEN {col} <= 59 THEN '40-59' "
            f"WHEN {col} <= 79 THEN '60-79' WHEN {col} IS NOT NULL THEN '80-99' END")


@register("sector_hhi_by_phase", Q.with_tagged(f"""
SELECT phase, hhi, CASE WHEN hhi < 1500 THEN 'unconcentrated' WHEN hhi < 2500 THEN 'moderately concentrated'
       ELSE 'highly concentrated' END AS band
FROM (SELECT p.label AS phase, round(CASE WHEN h.tot > 0 THEN h.hhi ELSE 0.0 END, 6) AS hhi
      FROM phases p LEFT JOIN h ON h.phase = p.label)""", PA, PH + f""",
st AS (SELECT p.label AS phase, sector, {MS} AS st FROM tagged {PJ} GROUP BY 1, 2),
sh AS (SELECT phase, st, 100 * st / sum(st) OVER (PARTITION BY phase) AS share FROM st),
h AS (SELECT phase, sum(power(share, 2)) AS hhi, sum(st) AS tot FROM sh GROUP BY phase)"""))
def q_sector_hhi_by_phase(spark, sf):
    """Sector concentration (HHI) per phase with its band."""
    return R.sector_hhi_by_phase(feat(spark, sf), PA)


@register("hhi_bands", Q.with_tagged("""
SELECT phase, CASE WHEN hhi < 1500 THEN 'unconcentrated' WHEN hhi < 2500 THEN 'moderately concentrated'
       ELSE 'highly concentrated' END AS band
FROM (SELECT p.label AS phase, round(CASE WHEN h.tot > 0 THEN h.hhi ELSE 0.0 END, 6) AS hhi
      FROM phases p LEFT JOIN h ON h.phase = p.label)""", PA, PH + f""",
st AS (SELECT p.label AS phase, sector, {MS} AS st FROM tagged {PJ} GROUP BY 1, 2),
sh AS (SELECT phase, st, 100 * st / sum(st) OVER (PARTITION BY phase) AS share FROM st),
h AS (SELECT phase, sum(power(share, 2)) AS hhi, sum(st) AS tot FROM sh GROUP BY phase)"""))
def q_hhi_bands(spark, sf):
    """Concentration band label per phase."""
    return R.sector_hhi_by_phase(feat(spark, sf), PA).select("phase", "band")


@register("year_total", Q.with_tagged(f"SELECT year, {MS} AS total FROM tagged GROUP BY year"))
def q_year_total(spark, sf):
    """A1"""
    return R.year_total(feat(spark, sf))


@register("investor_counts_by_phase", Q.with_tagged("""
SELECT phase, investor, n, "rank", min(n) OVER () AS global_min, max(n) OVER () AS global_max FROM (
  SELECT phase, investor, n, CAST(row_number() OVER (PARTITION BY phase ORDER BY n DESC, investor) AS INT) AS "rank"
  FROM c) WHERE "rank" <= 20""", PA, PH + f""",
c AS (SELECT p.label AS phase, investor, count(*) AS n FROM tagged {PJ} GROUP BY 1, 2)"""))
def q_investor_counts_by_phase(spark, sf):
    """Top-20 investors by deal count per phase + shared min/max."""
    return R.investor_counts_by_phase(feat(spark, sf), PA)


@register("top20_investors", Q.with_tagged("""
SELECT phase, investor, n FROM (
  SELECT phase, investor, n, row_number() OVER (PARTITION BY phase ORDER BY n DESC, investor) AS r FROM c)
WHERE r <= 20""", PA, PH + f""",
c AS (SELECT p.label AS phase, investor, count(*) AS n FROM tagged {PJ} GROUP BY 1, 2)"""))
def q_top20_investors(spark, sf):
    """L2"""
    return R.investor_counts_by_phase(feat(spark, sf), PA).select("phase", "investor", "n")


@register("global_extremes", Q.with_tagged("""
SELECT min(n) AS global_min, max(n) AS global_max FROM (
  SELECT n, row_number() OVER (PARTITION BY phase ORDER BY n DESC, investor) AS r FROM c) WHERE r <= 20""",
                                           PA, PH + f""",
c AS (SELECT p.label AS phase, investor, count(*) AS n FROM tagged {PJ} GROUP BY 1, 2)"""))
def q_global_extremes(spark, sf):
    """Shared scale across the per-phase top lists."""
    return R.investor_counts_by_phase(feat(spark, sf), PA).select("global_min", "global_max").distinct()


@register("sector_total_by_phase", Q.with_tagged(
    f"SELECT p.label AS phase, sector, {MS} AS total FROM tagged {PJ} GROUP BY 1, 2", PA, PH))
def q_sector_total_by_phase(spark, sf):
    """A3"""
    return R.sector_total_by_phase(feat(spark, sf), PA)


@register("greenfield_split_by_phase", Q.with_tagged("""
SELECT phase, greenfield, other, greenfield + other AS total,
       round(100 * greenfield / (greenfield + other), 6) AS greenfield_pct,
       round((greenfield + other) / 1000, 6) AS total_thousands
FROM (SELECT p.label AS phase,
        CAST(sum(CASE WHEN deal_type = 'Greenfield' THEN CAST(amount AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS greenfield,
        CAST(sum(CASE WHEN deal_type = 'M&A' THEN CAST(amount AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS other
      FROM tagged """ + PJ + """ GROUP BY 1) WHERE greenfield + other <> 0""", PA, PH))
def q_greenfield_split_by_phase(spark, sf):
    """A4"""
    return R.greenfield_split_by_phase(feat(spark, sf), PA)


@register("country_total_by_phase", Q.with_tagged(
    f"SELECT p.label AS phase, {country_case('country')} AS country_mapped, {MS} AS total FROM tagged {PJ} "
    "GROUP BY 1, 2", PA, PH))
def q_country_total_by_phase(spark, sf):
    """A5"""
    return R.country_total_by_phase(feat(spark, sf), PA)


@register("country_phase_extremes", Q.with_tagged(f"""
SELECT (SELECT max(total) FROM (SELECT {country_case('country')} AS c,
          CASE WHEN year > 1994 AND year <= 1997 THEN 'p1' WHEN year > 1997 AND year <= 1999 THEN 'p2'
               WHEN year > 1999 AND year <= 2001 THEN 'p3' END AS ybin, {MS} AS total
        FROM tagged GROUP BY 1, 2)) AS max_bin_total,
       (SELECT min(amount) FROM tagged) AS min_amount"""))
def q_country_phase_extremes(spark, sf):
    """A6/F15"""
    return R.country_phase_extremes(feat(spark, sf), PA)


_LEAVES = PH + f""",
leaves AS (SELECT p.label AS phase, sector, subsector, sum(CAST(amount AS DECIMAL(28,6))) AS v
           FROM tagged {PJ} GROUP BY 1, 2, 3 HAVING sum(CAST(amount AS DECIMAL(28,6))) > 0)"""
_HIER = Q.with_tagged("""
SELECT phase, subsector AS label, sector AS parent, CAST(v AS DOUBLE) AS value, 'leaf' AS node FROM leaves
UNION ALL
SELECT phase, sector AS label, '' AS parent, CAST(sum(v) AS DOUBLE) AS value, 'parent' AS node FROM leaves GROUP BY 1, 2""",
                      PA, _LEAVES)


@register("sector_subsector_rollup", _HIER)
def q_sector_subsector_rollup(spark, sf):
    """Leaves with sum > 0 and their sector parents, via rollup."""
    return R.sector_subsector_rollup(feat(spark, sf), PA)


@register("union_hierarchy", _HIER)
def q_union_hierarchy(spark, sf):
    """The same node list built as leaves UNION parents."""
    f = feat(spark, sf)
    leaves = (R.phase_range_join(f.select("year", "sector", "subsector", "amount"), PA)
              .groupBy(F.col("phase_label").alias("phase"), "sector", "subsector")
              .agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("v")).where(F.col("v") > 0))
    lv = leaves.select("phase", F.col("subsector").alias("label"), F.col("sector").alias("parent"),
                       F.col("v").cast("double").alias("value"), F.lit("leaf").alias("node"))
    pa = leaves.groupBy("phase", "sector").agg(F.sum("v").cast("double").alias("value")).select(
        "phase", F.col("sector").alias("label"), F.lit("").alias("parent"), "value", F.lit("parent").alias("node"))
    return lv.unionByName(pa)


@register("nonempty_groups", Q.with_tagged("SELECT phase, sector, subsector, CAST(v AS DOUBLE) AS total FROM leaves",
                                           PA, _LEAVES))
def q_nonempty_groups(spark, sf):
    """Group sums kept only when > 0 (HAVING)."""
    from ..operators.clean import nonempty_groups
    f = feat(spark, sf)
    g = (R.phase_range_join(f.select("year", "sector", "subsector", "amount"), PA)
         .groupBy(F.col("phase_label").alias("phase"), "sector", "subsector")
         .agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("total")))
    return nonempty_groups(g, "total").withColumn("total", F.col("total").cast("double"))


def _pivot_cells() -> str:
    """One conditional sum per region of the driver tables (fixed names)."""
    cell = 'COALESCE(CAST(sum(CASE WHEN region = \'{0}\' THEN a END) AS DOUBLE), 0) AS "{0}"'
    return ", ".join(cell.format(r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))


@register("region_year_pivot", Q.with_tagged(f"SELECT year, {_pivot_cells()} FROM kept GROUP BY year", PA, f"""
top AS (SELECT region FROM tagged GROUP BY region ORDER BY {MS} DESC, region LIMIT 7),
kept AS (SELECT year, region, CAST(amount AS DECIMAL(28,6)) AS a FROM tagged WHERE region IN (SELECT region FROM top))"""))
def q_region_year_pivot(spark, sf):
    """A8/P6"""
    return R.region_year_pivot(feat(spark, sf), PA)


@register("top7_regions", Q.with_tagged(
    f"SELECT country, {MS} AS total FROM tagged GROUP BY country ORDER BY total DESC, country LIMIT 7"))
def q_top7_regions(spark, sf):
    """L3 on the 25 nations (the tables have only 5 regions)."""
    return R.top_groups(feat(spark, sf), "country", 7)


@register("isin_top_groups", Q.with_tagged(f"""
SELECT deal_id, region, amount FROM tagged
WHERE region IN (SELECT region FROM tagged GROUP BY region ORDER BY {MS} DESC, region LIMIT 3)"""))
def q_isin_top_groups(spark, sf):
    """Rows of the top-3 regions (left-semi join on the computed set)."""
    from ..operators.clean import isin_top_groups
    f = feat(spark, sf)
    return isin_top_groups(f.select("deal_id", "region", "amount"), R.top_groups(f, "region", 3), "region")


def _share(group):
    return f"""s AS (SELECT {group},
   COALESCE(CAST(sum(CASE WHEN post_policy = 0 THEN CAST(amount AS DECIMAL(28,6)) END) AS DOUBLE), 0) AS pre,
   COALESCE(CAST(sum(CASE WHEN post_policy = 1 THEN CAST(amount AS DECIMAL(28,6)) END) AS DOUBLE), 0) AS post
   FROM tagged GROUP BY {group}),
sh AS (SELECT {group}, 100 * pre / sum(pre) OVER () AS pre_share, 100 * post / sum(post) OVER () AS post_share FROM s),
shift AS (SELECT {group}, round(pre_share, 6) AS pre_share, round(post_share, 6) AS post_share,
          round(post_share - pre_share, 6) AS change FROM sh)"""


@register("share_shift", Q.with_tagged("SELECT * FROM shift", PA, _share("sector")))
def q_share_shift(spark, sf):
    """A13"""
    return R.share_shift(feat(spark, sf))


def _top_bottom(n):
    return Q.with_tagged(f"""
SELECT country, pre_share, post_share, change FROM (SELECT *, row_number() OVER (ORDER BY change DESC, country) AS r FROM shift) WHERE r <= {n}
UNION
SELECT country, pre_share, post_share, change FROM (SELECT *, row_number() OVER (ORDER BY change ASC, country) AS r FROM shift) WHERE r <= {n}""",
                         PA, _share("country"))


@register("top_bottom_shift", _top_bottom(7))
def q_top_bottom_shift(spark, sf):
    """L4: the 7 nations that gained and the 7 that lost most."""
    return R.top_bottom_shift(feat(spark, sf), 7, "country")


@register("union_top_bottom", _top_bottom(15))
def q_union_top_bottom(spark, sf):
    """Concat of two ranked frames that overlap (15 + 15 of 25 nations), duplicates dropped."""
    return R.top_bottom_shift(feat(spark, sf), 15, "country")


@register("year_type_pivot", Q.with_tagged("""
SELECT year,
  COALESCE(CAST(sum(CASE WHEN deal_type = 'Greenfield' THEN CAST(amount AS DECIMAL(28,6)) END) AS DOUBLE), 0) AS "Greenfield",
  COALESCE(CAST(sum(CASE WHEN deal_type = 'M&A' THEN CAST(amount AS DECIMAL(28,6)) END) AS DOUBLE), 0) AS "M&A"
FROM tagged GROUP BY year"""))
def q_year_type_pivot(spark, sf):
    """A14"""
    return R.year_type_pivot(feat(spark, sf))


@register("count_by_year_share", Q.with_tagged("""
SELECT year, n, round(n / sum(n) OVER (), 6) AS proportion FROM (SELECT year, count(*) AS n FROM tagged GROUP BY year)"""))
def q_count_by_year_share(spark, sf):
    """A15"""
    return R.count_by_year_share(feat(spark, sf))


_PB = Q.phases_values(PB)


@register("phase_bin_share_r", Q.with_deals(f"""
SELECT replace(phase, '_', ' ') AS phase, bin, amount_sum,
       round(amount_sum / sum(amount_sum) OVER (PARTITION BY phase), 6) AS proportion
FROM (SELECT p.label AS phase, {bin_case_r('CAST(share_size AS DOUBLE)')} AS bin, {MS} AS amount_sum
      FROM deals JOIN phases p ON year BETWEEN p.lo AND p.hi
      WHERE amount IS NOT NULL AND year IS NOT NULL AND {bin_case_r('CAST(share_size AS DOUBLE)')} IS NOT NULL
      GROUP BY 1, 2)""", _PB))
def q_phase_bin_share_r(spark, sf):
    """A16/F24 with the R rule set (phase flags unpivoted)."""
    return R.phase_bin_share_r(clean_rows_r(deals(spark, sf)), PB)


@register("share_bin_totals", Q.with_tagged(f"""
SELECT s.phase, s.bin, COALESCE(g.total, 0.0) AS total,
       CASE WHEN sum(COALESCE(g.total, 0.0)) OVER (PARTITION BY s.phase) > 0
            THEN round(100 * COALESCE(g.total, 0.0) / sum(COALESCE(g.total, 0.0)) OVER (PARTITION BY s.phase), 6) END AS pct
FROM (SELECT label AS phase, bin FROM phases, (VALUES ('0-19'), ('20-39'), ('40-59'), ('60-79'), ('80-99')) b(bin)) s
LEFT JOIN g ON g.phase = s.phase AND g.bin = s.bin""", PA, PH + f""",
g AS (SELECT p.label AS phase, {bin_case('CAST(share_size AS DOUBLE)')} AS bin, {MS} AS total FROM tagged {PJ}
      WHERE {bin_case('CAST(share_size AS DOUBLE)')} IS NOT NULL GROUP BY 1, 2)"""))
def q_share_bin_totals(spark, sf):
    """A10/F13"""
    return R.share_bin_totals(feat(spark, sf), PA)


@register("group_means", Q.with_tagged(
    "SELECT deal_type, round(avg(amount), 6) AS mean, count(*) AS n FROM tagged GROUP BY deal_type"))
def q_group_means(spark, sf):
    """A11"""
    return R.group_means(feat(spark, sf), "deal_type")


_NUM = ["year", "month", "amount", "share_size", "log_amount", "post_policy", "policy_cumulative",
        "roll_mean_2", "roll_std_2", "roll_mean_3", "roll_std_3", "sector_blend", "region_blend"]
_CAT = ["investor", "party", "sector", "subsector", "country", "region", "phase", "deal_type"]


@register("describe_numeric", Q.with_features(f"""
SELECT column_name, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
       max(x) AS max, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75
FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUM)} FROM feat)
      ON {', '.join(_NUM)} INTO NAME column_name VALUE x)
GROUP BY column_name"""))
def q_describe_numeric(spark, sf):
    """A12 (numeric columns)"""
    return R.describe_numeric(feat(spark, sf), _NUM)


@register("describe_categorical", Q.with_features(f"""
SELECT column_name, CAST(sum(c) AS BIGINT) AS count, count(*) AS "unique", first(v ORDER BY c DESC, v) AS top, max(c) AS freq
FROM (SELECT column_name, v, count(*) AS c FROM
      (UNPIVOT (SELECT {', '.join(_CAT)} FROM feat) ON {', '.join(_CAT)} INTO NAME column_name VALUE v)
      WHERE v IS NOT NULL GROUP BY 1, 2)
GROUP BY column_name"""))
def q_describe_categorical(spark, sf):
    """A12 (text columns): count, unique, top, freq."""
    return R.describe_categorical(feat(spark, sf), _CAT)


@register("target_balance", Q.with_features(
    "SELECT round(avg(high_value) * 100, 6) AS pct_high, round(quantile_cont(amount, 0.5), 6) AS median_amount FROM feat"))
def q_target_balance(spark, sf):
    """A17"""
    return R.target_balance(feat(spark, sf))


@register("exact_quantile", Q.with_tagged("""
SELECT year, round(quantile_cont(amount, 0.5), 6) AS q50, round(quantile_cont(amount, 0.7), 6) AS q70
FROM tagged GROUP BY year
UNION ALL
SELECT NULL, round(quantile_cont(amount, 0.5), 6), round(quantile_cont(amount, 0.7), 6) FROM tagged"""))
def q_exact_quantile(spark, sf):
    """Exact linear quantiles (two-pass sketch bracket, exact pick)."""
    return R.exact_quantile_report(feat(spark, sf))


_DL = ["year", "sector", "region", "investor", "country", "phase", "subsector"]


@register("distinct_levels", Q.with_tagged(
    "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in _DL) + " FROM tagged"))
def q_distinct_levels(spark, sf):
    """A19"""
    return R.distinct_levels(feat(spark, sf), _DL)


#: Deals as an export might have them: amounts missing, zero or negative, years missing or out of range.
_DIRTY = """dirty AS (SELECT * REPLACE (
  CASE WHEN deal_id % 11 = 0 THEN NULL WHEN deal_id % 13 = 0 THEN -amount WHEN deal_id % 17 = 0 THEN 0 ELSE amount END AS amount,
  CASE WHEN deal_id % 19 = 0 THEN NULL WHEN deal_id % 23 = 0 THEN year + 1000 ELSE year END AS year) FROM deals)"""
_DIRTY_CLEAN = _DIRTY + ",\n" + Q.clean(PA).replace("FROM deals", "FROM dirty")


def _dirty(spark, sf):
    k = F.col("deal_id")
    amount = F.when(k % 11 != 0, F.when(k % 13 == 0, -F.col("amount")).when(k % 17 == 0, F.lit(0)).otherwise(F.col("amount")))
    return deals(spark, sf).withColumns({"amount": amount, "year": F.when(k % 19 != 0, F.col("year") + F.when(k % 23 == 0, 1000).otherwise(0))})


@register("year_range", Q.with_deals(f"""
SELECT (SELECT count(*) FROM dirty) AS rows_in, count(*) AS rows_out, min(year) AS min_year, max(year) AS max_year,
       (SELECT count(*) FROM dirty) - count(*) AS rows_removed
FROM clean""", _DIRTY_CLEAN))
def q_year_range(spark, sf):
    """Data-quality counts of the cleaning step on dirty deals."""
    d = _dirty(spark, sf)
    return R.year_range(d, clean_rows(d, PA)).select("rows_in", "rows_out", "min_year", "max_year", "rows_removed")


@register("left_join_country_totals", Q.with_tagged(f"""
SELECT d.country_mapped, t.total, p.label AS phase
FROM (SELECT DISTINCT {country_case('n_name')} AS country_mapped FROM nation) d CROSS JOIN phases p
LEFT JOIN t ON t.country_mapped = d.country_mapped AND t.phase = p.label""", PA, PH + f""",
t AS (SELECT p.label AS phase, {country_case('country')} AS country_mapped, {MS} AS total FROM tagged {PJ} GROUP BY 1, 2)"""))
def q_left_join_country_totals(spark, sf):
    """J1"""
    return R.left_join_country_totals(feat(spark, sf), table(spark, sf, "nation"), PA)


@register("phase_range_join", Q.with_tagged(f"SELECT deal_id, p.label AS phase FROM tagged {PJ}", PA, PH))
def q_phase_range_join(spark, sf):
    """Each deal with the phase(s) whose year range holds it."""
    f = feat(spark, sf)
    return R.phase_range_join(f.select("deal_id", "year"), PA).select("deal_id", F.col("phase_label").alias("phase"))


@register("phase_slice", Q.with_tagged("SELECT deal_id, year FROM tagged WHERE year BETWEEN 1998 AND 1999"))
def q_phase_slice(spark, sf):
    """One inclusive phase slice (partition-pruned read of the year-partitioned table)."""
    from ..operators.clean import phase_slice
    return phase_slice(feat(spark, sf), 1998, 1999).select("deal_id", "year")


@register("group_stat_join_back", Q.with_tagged(
    "SELECT deal_id, sector, amount, round(avg(amount) OVER (PARTITION BY sector), 6) AS group_mean FROM tagged"))
def q_group_stat_join_back(spark, sf):
    """J3"""
    return R.group_stat_join_back(feat(spark, sf))


_TOPP = """tp AS (SELECT party FROM (SELECT party, rank() OVER (ORDER BY count(*) DESC) AS r FROM deals GROUP BY party)
       WHERE r <= 25)"""


@register("semi_join_top", Q.with_deals("SELECT deal_id, party, amount FROM deals WHERE party IN (SELECT party FROM tp)",
                                        _TOPP))
def q_semi_join_top(spark, sf):
    """Rows of the top-25 counter-parties by count (ties kept)."""
    return R.semi_join_top(deals(spark, sf), "party", 25)


@register("top_n_with_ties", Q.with_deals("""
SELECT investor, n, CAST(r AS INT) AS "rank" FROM (
  SELECT investor, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM deals GROUP BY investor)
WHERE r <= 30"""))
def q_top_n_with_ties(spark, sf):
    """The 30 busiest investors and those that tie with the last."""
    return R.top_n_with_ties(deals(spark, sf), "investor", 30)


@register("share_of_total", Q.with_tagged(
    f"SELECT sector, total, round(total / sum(total) OVER (), 6) AS share FROM (SELECT sector, {MS} AS total FROM tagged GROUP BY 1)"))
def q_share_of_total(spark, sf):
    """W6"""
    return R.share_of_total(feat(spark, sf))


@register("top5_per_group", Q.with_tagged("""
SELECT deal_type, deal_id, amount, CAST(r AS INT) AS "rank" FROM (
  SELECT deal_type, deal_id, amount, row_number() OVER (PARTITION BY deal_type ORDER BY amount DESC, deal_id) AS r
  FROM tagged) WHERE r <= 5"""))
def q_top5_per_group(spark, sf):
    """W7"""
    return R.top5_per_group(feat(spark, sf), "deal_type")


@register("donut_label_position", Q.with_tagged(f"""
SELECT year, total, round(sum(total) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) - total / 2, 6) AS position
FROM (SELECT year, {MS} AS total FROM tagged GROUP BY year)"""))
def q_donut_label_position(spark, sf):
    """W9"""
    return R.donut_label_position(feat(spark, sf))


_CODED = ["sector", "region", "deal_type", "phase", "subsector"]


@register("category_codes", Q.with_tagged(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS level, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS code "
    f"FROM (SELECT DISTINCT {c} FROM tagged)" for c in _CODED)))
def q_category_codes(spark, sf):
    """W10"""
    return R.category_code_table(feat(spark, sf), _CODED)


@register("sort_by_year", Q.with_tagged(
    "SELECT deal_id, year, row_number() OVER (ORDER BY year, deal_id) AS position FROM tagged"))
def q_sort_by_year(spark, sf):
    """L1: position of every deal in (year, deal_id) order."""
    return R.row_positions(feat(spark, sf))


_MONTHS = ", ".join(f"('{m}', {i + 1})" for i, m in enumerate(MONTH_NAMES))


@register("calendar_order", Q.with_tagged(f"""
SELECT c.name AS month_name, c.pos AS position FROM (VALUES {_MONTHS}) c(name, pos)
WHERE c.pos IN (SELECT DISTINCT month FROM tagged)"""))
def q_calendar_order(spark, sf):
    """Month names present, with their calendar position."""
    from ..functions import scalar as S
    f = feat(spark, sf)
    return f.select(S.month_name("month").alias("month_name")).distinct().select(
        "month_name", S.calendar_position("month_name").cast("int").alias("position"))


@register("level_intersection", Q.with_tagged(f"""
SELECT c.name AS month_name, c.pos AS position FROM (VALUES {_MONTHS}) c(name, pos)
WHERE c.pos IN (SELECT DISTINCT month FROM tagged)"""))
def q_level_intersection(spark, sf):
    """U4: fixed calendar INTERSECT observed month levels."""
    return R.calendar_order(feat(spark, sf))


@register("dummy_encode", Q.with_tagged("""
SELECT deal_id, year, round(log_amount, 6) AS log_amount, CAST(phase = 'p2' AS INT) AS phase_p2,
       CAST(phase = 'p3' AS INT) AS phase_p3 FROM tagged"""))
def q_dummy_encode(spark, sf):
    """0/1 column per phase level, first level dropped."""
    f = feat(spark, sf).withColumn("log_amount", F.round("log_amount", 6))
    return R.dummy_encode(f, "phase", ["deal_id", "year", "log_amount"])


@register("append_columns", Q.with_tagged("""
SELECT deal_id, year, round(log_amount, 6) AS log_amount, CAST(deal_type = 'M&A' AS INT) AS "deal_type_M&A",
       round(round(log_amount, 6) * year, 6) AS year_x_log FROM tagged"""))
def q_append_columns(spark, sf):
    """Predictors placed beside dummy columns."""
    f = feat(spark, sf).withColumn("log_amount", F.round("log_amount", 6))
    d = R.dummy_encode(f.withColumn("year_x_log", F.round(F.col("log_amount") * F.col("year"), 6)),
                       "deal_type", ["deal_id", "year", "log_amount", "year_x_log"])
    return d


@register("collect_results", Q.with_tagged(
    f"SELECT phase, count(*) AS n_obs, round(avg(log_amount), 6) AS mean_log, {MS} AS total FROM tagged GROUP BY phase"))
def q_collect_results(spark, sf):
    """Per-phase results in one grouped pass."""
    return R.phase_summary(feat(spark, sf))


@register("min_group_guard", Q.with_tagged("""
SELECT investor, count(*) AS n_rows, count(DISTINCT phase) AS n_levels,
       count(*) >= 12 AND count(DISTINCT phase) >= 2 AND NOT starts_with(investor, 'Customer#00000000') AS passes
FROM tagged GROUP BY investor"""))
def q_min_group_guard(spark, sf):
    """P10 on investors, of which some are too small, some have one phase and some are skipped by name."""
    from ..operators.clean import min_group_guard
    return min_group_guard(feat(spark, sf), "investor", 12, "phase", "Customer#00000000")


@register("clean_rows", Q.with_deals("SELECT deal_id, year, amount FROM clean", _DIRTY_CLEAN))
def q_clean_rows(spark, sf):
    """P1 on dirty deals"""
    return clean_rows(_dirty(spark, sf), PA).select("deal_id", "year", "amount")


@register("clean_rows_r", Q.with_deals(
    "SELECT deal_id, year, amount FROM dirty WHERE amount IS NOT NULL AND year IS NOT NULL", _DIRTY))
def q_clean_rows_r(spark, sf):
    """P2 on dirty deals: zero, negative and late ones stay"""
    return clean_rows_r(_dirty(spark, sf)).select("deal_id", "year", "amount")


@register("cap_outliers", Q.with_tagged(
    "SELECT deal_id, amount FROM tagged WHERE amount <= 300000"))
def q_cap_outliers(spark, sf):
    """P3 (box-plot cap)"""
    from ..operators.clean import cap_outliers
    return cap_outliers(feat(spark, sf), PA.amount_cap).select("deal_id", "amount")


@register("positive_log10", Q.with_tagged(
    "SELECT deal_id, round(log10(amount), 6) AS log10_amount FROM tagged WHERE amount > 0"))
def q_positive_log10(spark, sf):
    """P5"""
    from ..operators.clean import positive_log10
    return positive_log10(feat(spark, sf)).select("deal_id", F.round("log10_amount", 6).alias("log10_amount"))


@register("complete_cases", Q.with_features("""
SELECT deal_id FROM feat WHERE roll_std_2 IS NOT NULL AND share_size IS NOT NULL AND party IS NOT NULL"""))
def q_complete_cases(spark, sf):
    """P7"""
    from ..operators.clean import complete_cases
    return complete_cases(feat(spark, sf), ["roll_std_2", "share_size", "party"]).select("deal_id")


@register("prune_ml_columns", Q.with_features("""
SELECT deal_id, year, sector, region, round(roll_mean_3, 6) AS roll_mean_3, round(log_amount, 6) AS log_amount FROM feat"""))
def q_prune_ml_columns(spark, sf):
    """The model inputs only (the scan reads just these columns)."""
    from ..operators.clean import prune_columns
    f = prune_columns(feat(spark, sf), ["deal_id", "year", "sector", "region", "roll_mean_3", "log_amount"])
    return f.withColumn("roll_mean_3", F.round("roll_mean_3", 6)).withColumn("log_amount", F.round("log_amount", 6))


# ---------------------------------------------------------------- ordered features
@register("rolling_mean", Q.with_features(
    "SELECT deal_id, sector, round(roll_mean_2, 6) AS roll_mean_2, round(roll_mean_3, 6) AS roll_mean_3 FROM feat"))
def q_rolling_mean(spark, sf):
    """Per-sector mean of the last 2 / 3 deals in (year, deal_id) order."""
    f = feat(spark, sf)
    return f.select("deal_id", "sector", F.round("roll_mean_2", 6).alias("roll_mean_2"),
                    F.round("roll_mean_3", 6).alias("roll_mean_3"))


@register("rolling_std", Q.with_features(
    "SELECT deal_id, sector, round(roll_std_2, 6) AS roll_std_2, round(roll_std_3, 6) AS roll_std_3 FROM feat"))
def q_rolling_std(spark, sf):
    """Per-sector sample std of the last 2 / 3 deals (NULL on a sector's first deal)."""
    f = feat(spark, sf)
    return f.select("deal_id", "sector", F.round("roll_std_2", 6).alias("roll_std_2"),
                    F.round("roll_std_3", 6).alias("roll_std_3"))


@register("policy_cumulative", Q.with_features("SELECT deal_id, year, policy_cumulative FROM feat"))
def q_policy_cumulative(spark, sf):
    """Running count of post-policy deals over the whole ordered table."""
    return feat(spark, sf).select("deal_id", "year", "policy_cumulative")


@register("group_mean_blend", Q.with_features(
    "SELECT deal_id, round(sector_blend, 6) AS sector_blend, round(region_blend, 6) AS region_blend FROM feat"))
def q_group_mean_blend(spark, sf):
    """W4 (D2 fixed: the region blend uses the region mean)."""
    f = feat(spark, sf)
    return f.select("deal_id", F.round("sector_blend", 6).alias("sector_blend"),
                    F.round("region_blend", 6).alias("region_blend"))


@register("adaptive_target", Q.with_features("SELECT deal_id, year, amount, adaptive_target FROM feat"))
def q_adaptive_target(spark, sf):
    """1 if the amount is above its own year's exact 0.70 quantile."""
    return feat(spark, sf).select("deal_id", "year", "amount", "adaptive_target")


_DESC_ALL = ["column_name", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"]


@register("describe_all", Q.with_features(f"""
SELECT column_name, count(x) AS count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
       CAST(NULL AS BIGINT) AS freq, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
       round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max
FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUM)} FROM feat)
      ON {', '.join(_NUM)} INTO NAME column_name VALUE x)
GROUP BY column_name
UNION ALL
SELECT column_name, CAST(sum(c) AS BIGINT), count(*), first(v ORDER BY c DESC, v), max(c), NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT column_name, v, count(*) AS c FROM
      (UNPIVOT (SELECT {', '.join(_CAT)} FROM feat) ON {', '.join(_CAT)} INTO NAME column_name VALUE v)
      WHERE v IS NOT NULL GROUP BY 1, 2)
GROUP BY column_name"""))
def q_describe_all(spark, sf):
    """Summary of every column (numeric and text statistics side by side)."""
    f = feat(spark, sf)
    num = R.describe_numeric(f, _NUM)
    cat = R.describe_categorical(f, _CAT)
    num = num.select("column_name", "count", F.lit(None).cast("bigint").alias("unique"),
                     F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq"),
                     "mean", "std", "min", "q25", "q50", "q75", "max")
    cat = cat.select("column_name", "count", "unique", "top", "freq",
                     *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])
    return num.unionByName(cat).select(*_DESC_ALL)


@register("rolling_lagged", Q.with_features(
    "SELECT deal_id, sector, round(roll_lag_mean_2, 6) AS roll_lag_mean_2, round(roll_lag_std_2, 6) AS roll_lag_std_2, "
    "round(roll_lag_mean_3, 6) AS roll_lag_mean_3, round(roll_lag_std_3, 6) AS roll_lag_std_3 FROM feat"))
def q_rolling_lagged(spark, sf):
    """W1/W2 without the current deal (D11): statistics of the previous 2 / 3 deals."""
    f = feat(spark, sf)
    return f.select("deal_id", "sector", *[F.round(c, 6).alias(c) for c in (
        "roll_lag_mean_2", "roll_lag_std_2", "roll_lag_mean_3", "roll_lag_std_3")])


@register("group_mean_blend_loo", Q.with_features(
    "SELECT deal_id, round(sector_blend_loo, 6) AS sector_blend_loo, round(region_blend_loo, 6) AS region_blend_loo "
    "FROM feat"))
def q_group_mean_blend_loo(spark, sf):
    """W4 without the row itself (D11): leave-one-out group and global means."""
    f = feat(spark, sf)
    return f.select("deal_id", F.round("sector_blend_loo", 6).alias("sector_blend_loo"),
                    F.round("region_blend_loo", 6).alias("region_blend_loo"))
