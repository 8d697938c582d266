"""Scalar-function queries: each applies one expression to table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BRI_TOKENS, GREENFIELD_TOKENS, PRESET_A, PRESET_B, PUBLISHED
from ..functions import scalar as S
from ..operators import reports as R
from ..operators.features import features
from ..sources.deals import deals, table
from . import sql as Q
from .catalog_reports import bin_case, bin_case_r, country_case
from .registry import register

PA, PB = PRESET_A, PRESET_B


def _l(v):
    return ", ".join("'" + x + "'" for x in v)


STRIP = r"[\[\]$,%\s]"
STRICT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
FIRST = r"([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?)"


def _py_num(x: str) -> str:
    s = f"trim(regexp_replace({x}, '{STRIP}', '', 'g'))"
    e = f"regexp_extract({s}, '{FIRST}', 1)"
    return (f"CASE WHEN regexp_matches({s}, '{STRICT}') THEN TRY_CAST({s} AS DOUBLE) "
            f"WHEN {e} <> '' THEN TRY_CAST({e} AS DOUBLE) END")


def _r_num(x: str) -> str:
    s = f"replace(regexp_replace({x}, '[^0-9.,-]', '', 'g'), ',', '')"
    return f"CASE WHEN regexp_matches({s}, '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST({s} AS DOUBLE) END"


def _events_text(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", "props",
                     F.concat(F.lit("approx "), F.col("value").cast("string"), F.lit(" units")).alias("note"))


_EV = "SELECT event_id, props, 'approx ' || CAST(value AS VARCHAR) || ' units' AS note FROM events"


@register("clean_number", f"SELECT event_id, {_py_num('props')} AS props_num, {_py_num('note')} AS note_num FROM ({_EV})")
def q_clean_number(spark, sf):
    """F1 on event text: '{"k": 69}' -> 69; 'approx 6.55 units' -> 6.55."""
    e = _events_text(spark, sf)
    return e.select("event_id", S.clean_number("props").alias("props_num"), S.clean_number("note").alias("note_num"))


@register("clean_number_r", f"SELECT event_id, {_r_num('props')} AS props_num, {_r_num('note')} AS note_num FROM ({_EV})")
def q_clean_number_r(spark, sf):
    """F2 on event text (R rule)."""
    e = _events_text(spark, sf)
    return e.select("event_id", S.clean_number_r("props").alias("props_num"), S.clean_number_r("note").alias("note_num"))


@register("to_year", f"""SELECT o_orderkey, CAST({_py_num("' ' || CAST(year(o_orderdate) AS VARCHAR)")} AS INT) AS year,
  CASE WHEN regexp_matches(trim(o_orderstatus), '{STRICT}') THEN TRY_CAST(trim(o_orderstatus) AS DOUBLE) END AS status_num
FROM orders""")
def q_to_year(spark, sf):
    """numeric coercion of year text; non-numbers (order status letters) -> NULL."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    S.clean_number(F.concat(F.lit(" "), F.year("o_orderdate").cast("string"))).cast("int").alias("year"),
                    S.to_year("o_orderstatus").alias("status_num"))


@register("log_amount", Q.with_deals("SELECT deal_id, round(ln(amount), 6) AS log_amount FROM deals WHERE amount > 0"))
def q_log_amount(spark, sf):
    """F4"""
    return deals(spark, sf).where("amount > 0").select("deal_id", F.round(S.log_amount("amount"), 6).alias("log_amount"))


@register("back_transform", Q.with_deals(
    "SELECT deal_id, round(greatest(exp(ln(amount) - 11), 0.1), 6) AS amount_back FROM deals WHERE amount > 0"))
def q_back_transform(spark, sf):
    """exp of a log-scale value, floored at 0.1."""
    d = deals(spark, sf).where("amount > 0")
    return d.select("deal_id", F.round(S.back_transform(S.log_amount("amount") - 11, 0.1), 6).alias("amount_back"))


@register("post_policy_flag", Q.with_deals("SELECT deal_id, CAST(year >= 2000 AS INT) AS post_policy FROM deals"))
def q_post_policy_flag(spark, sf):
    """F6"""
    return deals(spark, sf).select("deal_id", S.post_policy_flag("year", PA.policy_year).alias("post_policy"))


@register("assign_phase", Q.with_deals(
    f"SELECT deal_id, {Q.phase_case(PA)} AS phase_a, {Q.phase_case(PUBLISHED)} AS phase_published FROM deals"))
def q_assign_phase(spark, sf):
    """F7 under the re-based and the published calendars (the latter puts every
    year of this data outside all phases: 'Fora (year)')."""
    d = deals(spark, sf)
    return d.select("deal_id", S.assign_phase("year", PA).alias("phase_a"),
                    S.assign_phase("year", PUBLISHED).alias("phase_published"))


@register("phase_flags", Q.with_deals("""SELECT deal_id, CAST(year BETWEEN 1995 AND 1997 AS INT) AS phase_1,
  CAST(year BETWEEN 1998 AND 1999 AS INT) AS phase_2, CAST(year >= 2000 AS INT) AS phase_3 FROM deals"""))
def q_phase_flags(spark, sf):
    """F8"""
    return deals(spark, sf).select("deal_id", *S.phase_flags("year", PA))


@register("phase_flags_r", Q.with_deals("""SELECT deal_id, CAST(year BETWEEN 1995 AND 1996 AS INT) AS phase_1,
  CAST(year BETWEEN 1997 AND 1999 AS INT) AS phase_2, CAST(year BETWEEN 2000 AND 2001 AS INT) AS phase_3,
  CAST(year BETWEEN 1999 AND 2001 AS INT) AS change_flag FROM deals"""))
def q_phase_flags_r(spark, sf):
    """F9"""
    return deals(spark, sf).select("deal_id", *S.phase_flags_r("year", PB))


@register("is_greenfield", Q.with_deals(f"""SELECT deal_id,
  CASE WHEN upper(trim(greenfield)) IN ({_l(GREENFIELD_TOKENS)}) THEN 'Greenfield' ELSE 'M&A' END AS deal_type,
  CASE WHEN upper(trim(greenfield)) IN ({_l(GREENFIELD_TOKENS)}) THEN 'Greenfield' ELSE 'Other' END AS deal_type_r
FROM deals"""))
def q_is_greenfield(spark, sf):
    """F10 (python label and R label)."""
    d = deals(spark, sf)
    return d.select("deal_id", S.is_greenfield("greenfield").alias("deal_type"),
                    S.is_greenfield("greenfield", "Other").alias("deal_type_r"))


@register("is_bri", Q.with_deals(
    f"SELECT deal_id, CASE WHEN lower(trim(bri)) IN ({_l(BRI_TOKENS)}) THEN 'BRI' ELSE 'Others' END AS bri_group FROM deals"))
def q_is_bri(spark, sf):
    """F11"""
    return deals(spark, sf).select("deal_id", S.is_bri("bri").alias("bri_group"))


@register("clean_category", Q.with_deals(
    f"SELECT deal_id, {Q.cat('party', 'Missing')} AS party, {Q.cat('bri', 'Missing')} AS bri, "
    f"{Q.cat('greenfield', 'Missing')} AS greenfield FROM deals"))
def q_clean_category(spark, sf):
    """F12"""
    d = deals(spark, sf)
    return d.select("deal_id", *[S.clean_category(c).alias(c) for c in ("party", "bri", "greenfield")])


@register("bin_share", Q.with_deals(f"SELECT deal_id, {bin_case('CAST(share_size AS DOUBLE)')} AS bin FROM deals"))
def q_bin_share(spark, sf):
    """F13"""
    return deals(spark, sf).select("deal_id", S.bin_share(F.col("share_size").cast("double")).alias("bin"))


@register("bin_share_r", Q.with_deals(f"SELECT deal_id, {bin_case_r('CAST(share_size AS DOUBLE)')} AS bin FROM deals"))
def q_bin_share_r(spark, sf):
    """F14"""
    return deals(spark, sf).select("deal_id", S.bin_share_r(F.col("share_size").cast("double")).alias("bin"))


@register("bin_year", Q.with_deals("""SELECT deal_id, CASE WHEN year > 1994 AND year <= 1997 THEN 'p1'
  WHEN year > 1997 AND year <= 1999 THEN 'p2' WHEN year > 1999 AND year <= 2001 THEN 'p3' END AS year_bin FROM deals"""))
def q_bin_year(spark, sf):
    """F15"""
    return deals(spark, sf).select("deal_id", S.bin_year("year", PA).alias("year_bin"))


@register("map_country", f"SELECT n_nationkey, {country_case('n_name')} AS country_mapped FROM nation")
def q_map_country(spark, sf):
    """F16 on the nation dimension."""
    return table(spark, sf, "nation").select("n_nationkey", S.map_country("n_name").alias("country_mapped"))


@register("interactions", Q.with_features(
    "SELECT deal_id, policy_interaction, sector_year_int, region_policy_int FROM feat"))
def q_interactions(spark, sf):
    """F17"""
    return features(spark, sf, PA).select("deal_id", "policy_interaction", "sector_year_int", "region_policy_int")


@register("binary_target", Q.with_features("SELECT deal_id, high_value, high_value_70 FROM feat"))
def q_binary_target(spark, sf):
    """above the exact median / 0.70 quantile (strict)."""
    return features(spark, sf, PA).select("deal_id", "high_value", "high_value_70")


@register("format_money", Q.with_tagged("""
SELECT year, CASE WHEN m >= 1000 THEN printf('$%.1fB', m / 1000) ELSE printf('$%.0fM', m) END AS label
FROM (SELECT year, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) / 1000000 * 3 AS m FROM tagged GROUP BY year)"""))
def q_format_money(spark, sf):
    """F19 on yearly totals (in millions, scaled)."""
    t = R.year_total(features(spark, sf, PA))
    return t.select("year", S.format_money(F.col("total") / 1000000 * 3).alias("label"))


@register("phase_label_text", Q.with_deals(f"""
SELECT deal_id, trim(replace(replace(phase, 'Going_Global', 'Going Global '), '.0', '')) AS phase_text
FROM (SELECT deal_id, p.label AS phase FROM deals JOIN phases p ON year BETWEEN p.lo AND p.hi)""", Q.phases_values(PB)))
def q_phase_label_text(spark, sf):
    """R phase flag names -> display text."""
    d = R.phase_range_join(deals(spark, sf).select("deal_id", "year"), PB)
    return d.select("deal_id", S.phase_label_text("phase_label").alias("phase_text"))


@register("year_to_date", Q.with_deals("SELECT deal_id, make_date(year, 1, 1) AS ds FROM deals"))
def q_year_to_date(spark, sf):
    """F21"""
    return deals(spark, sf).select("deal_id", S.year_to_date("year").alias("ds"))


@register("round_label", Q.with_deals("SELECT deal_id, round_even(amount, 0) AS amount_label FROM deals"))
def q_round_label(spark, sf):
    """half to even."""
    return deals(spark, sf).select("deal_id", S.round_label("amount").alias("amount_label"))


@register("unknown_level", Q.with_deals(
    "SELECT deal_id, COALESCE(party, 'Unknown') AS party, COALESCE(greenfield, 'Unknown') AS greenfield FROM deals"))
def q_unknown_level(spark, sf):
    """F23"""
    d = deals(spark, sf)
    return d.select("deal_id", S.unknown_level("party").alias("party"), S.unknown_level("greenfield").alias("greenfield"))


@register("unpivot_phase", Q.with_deals(f"""
SELECT deal_id, p.label AS phase FROM deals JOIN phases p ON year BETWEEN p.lo AND p.hi""", Q.phases_values(PB)))
def q_unpivot_phase(spark, sf):
    """phase flag columns -> (phase, flag) rows, flag = 1 kept."""
    d = deals(spark, sf)
    flags = d.select("deal_id", *[F.col("year").between(p.lo, p.hi).cast("int").alias(p.label) for p in PB.phases])
    return (flags.unpivot(["deal_id"], [F.col(f"`{p.label}`") for p in PB.phases], "phase", "flag")
            .where("flag = 1").drop("flag"))


@register("effect_percent", Q.with_features(
    "SELECT deal_id, round((exp(log_amount - sector_blend) - 1) * 100, 6) AS effect_pct FROM feat"))
def q_effect_percent(spark, sf):
    """F26"""
    f = features(spark, sf, PA)
    return f.select("deal_id", F.round(S.effect_percent(F.col("log_amount") - F.col("sector_blend")), 6).alias("effect_pct"))


@register("replace_values", Q.with_deals(f"""SELECT deal_id,
  CASE WHEN upper(trim(greenfield)) IN ({_l(GREENFIELD_TOKENS)}) THEN 'Greenfield' ELSE 'M&A' END AS deal_type FROM deals"""))
def q_replace_values(spark, sf):
    """R label 'Other' replaced by 'M&A'."""
    d = deals(spark, sf)
    return d.select("deal_id", S.replace_values(S.is_greenfield("greenfield", "Other"), {"Other": "M&A"}).alias("deal_type"))


@register("inf_to_null", Q.with_deals(
    "SELECT deal_id, CAST(isfinite(exp(amount / 500)) AS INT) AS finite, "
    "CASE WHEN isfinite(exp(amount / 500)) THEN round(amount / 500, 6) END AS exponent FROM deals"))
def q_inf_to_null(spark, sf):
    """overflowing values (exp of large exponents) -> NULL."""
    d = deals(spark, sf)
    v = S.inf_to_null(F.exp(F.col("amount") / 500))
    return d.select("deal_id", v.isNotNull().cast("int").alias("finite"),
                    F.when(v.isNotNull(), F.round(F.col("amount") / 500, 6)).alias("exponent"))


@register("percent_label", Q.with_tagged(
    "SELECT year, printf('%.1f%%', n / sum(n) OVER () * 100) AS label FROM (SELECT year, count(*) AS n FROM tagged GROUP BY year)"))
def q_percent_label(spark, sf):
    """F29"""
    c = R.count_by_year_share(features(spark, sf, PA)).drop("proportion")
    from pyspark.sql import Window
    return c.select("year", S.percent_label(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("label"))


@register("month_name", Q.with_deals("SELECT deal_id, monthname(make_date(2000, month, 1)) AS month_name FROM deals"))
def q_month_name(spark, sf):
    """L7 helper: month number -> calendar name."""
    return deals(spark, sf).select("deal_id", S.month_name("month").alias("month_name"))
