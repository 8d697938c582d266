"""Independent oracle text (DuckDB dialect) for the registered queries.

These strings are written from the operator semantics, not generated from the
Spark plans. They share common table expressions: the deals view, the cleaned and
tagged rows and the full feature table (which uses plain whole-table windows,
the brute-force definition of what the Spark side computes in chunks).
"""

from __future__ import annotations

from ..config import GREENFIELD_TOKENS, MISSING_TOKENS, PRESET_A, Preset


def _list(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


DEALS = """li AS (SELECT l_orderkey, max(l_discount) AS mx, min(l_suppkey) AS sk FROM lineitem GROUP BY 1),
deals AS (
SELECT o_orderkey AS deal_id,
       CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
       c_name AS investor, o_totalprice AS amount,
       CAST(round(mx * 1000) AS INT) AS share_size, s_name AS party,
       c_mktsegment AS sector, o_orderpriority AS subsector, n_name AS country, r_name AS region,
       CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'P' THEN ' bri ' ELSE '' END AS bri,
       CASE o_orderkey % 5 WHEN 0 THEN 'G' WHEN 1 THEN ' greenfield' WHEN 2 THEN '' WHEN 3 THEN 'M&A' END AS greenfield
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = sk)"""


def phase_case(p: Preset, col: str = "year") -> str:
    parts = []
    for ph in p.phases:
        cond = f"{col} BETWEEN {ph.lo} AND {ph.hi}" if ph.hi is not None else f"{col} >= {ph.lo}"
        parts.append(f"WHEN {cond} THEN '{ph.label}'")
    return f"CASE {' '.join(parts)} ELSE '{p.outside_prefix} (' || CAST({col} AS VARCHAR) || ')' END"


def phases_values(p: Preset) -> str:
    rows = ", ".join(f"('{ph.label}', {ph.lo}, {ph.hi}, {i + 1})" for i, ph in enumerate(p.phases))
    return f"phases(label, lo, hi, ord) AS (VALUES {rows})"


def cat(col: str, missing: str) -> str:
    return f"trim(CASE WHEN {col} IS NULL OR {col} IN ({_list(MISSING_TOKENS)}) THEN '{missing}' ELSE {col} END)"


def clean(p: Preset = PRESET_A) -> str:
    return f"""clean AS (SELECT deal_id, CAST(year AS INT) AS year, month, investor, amount, share_size, party, sector,
       subsector, country, region, bri, greenfield FROM deals
  WHERE amount IS NOT NULL AND year IS NOT NULL AND amount > 0 AND year <= {p.max_year})"""


def tagged(p: Preset = PRESET_A) -> str:
    m = p.missing_label
    flags = []
    for i, ph in enumerate(p.phases):
        last = i == len(p.phases) - 1
        cond = f"year >= {ph.lo}" if last else f"year BETWEEN {ph.lo} AND {ph.hi}"
        flags.append(f"CAST({cond} AS INT) AS phase_{i + 1}")
    return f"""tagged0 AS (SELECT deal_id, year, month, amount, share_size, party, bri, greenfield,
       {cat('investor', m)} AS investor, {cat('sector', m)} AS sector, {cat('subsector', m)} AS subsector,
       {cat('country', m)} AS country, {cat('region', m)} AS region,
       ln(amount) AS log_amount, CAST(year >= {p.policy_year} AS INT) AS post_policy,
       {phase_case(p)} AS phase0,
       CASE WHEN upper(trim(greenfield)) IN ({_list(GREENFIELD_TOKENS)}) THEN 'Greenfield' ELSE 'M&A' END AS deal_type0,
       {', '.join(flags)}
  FROM clean),
tagged AS (SELECT * EXCLUDE (phase0, deal_type0), {cat('phase0', m)} AS phase, {cat('deal_type0', m)} AS deal_type,
       post_policy * year AS policy_interaction FROM tagged0)"""


def features(p: Preset = PRESET_A) -> str:
    codes = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {c}_code"
                      for c in ["sector", "region", "deal_type", "phase", "subsector"])
    roll = []
    for k in (2, 3):
        w = f"OVER (PARTITION BY sector ORDER BY year, deal_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        roll.append(f"avg(amount) {w} AS roll_mean_{k}")
        roll.append(f"stddev_samp(amount) {w} AS roll_std_{k}")
    for k in (2, 3):
        w = f"OVER (PARTITION BY sector ORDER BY year, deal_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        roll.append(f"avg(amount) {w} AS roll_lag_mean_{k}")
        roll.append(f"stddev_samp(amount) {w} AS roll_lag_std_{k}")
    return f"""feat0 AS (SELECT *, {codes},
       CAST(amount > quantile_cont(amount, 0.5) OVER () AS INT) AS high_value,
       CAST(amount > quantile_cont(amount, 0.7) OVER () AS INT) AS high_value_70,
       CAST(amount > quantile_cont(amount, 0.7) OVER (PARTITION BY year) AS INT) AS adaptive_target,
       0.7 * avg(log_amount) OVER (PARTITION BY sector) + 0.3 * avg(log_amount) OVER () AS sector_blend,
       0.7 * avg(log_amount) OVER (PARTITION BY region) + 0.3 * avg(log_amount) OVER () AS region_blend,
       0.7 * (sum(log_amount) OVER (PARTITION BY sector) - log_amount) / NULLIF(count(*) OVER (PARTITION BY sector) - 1, 0)
         + 0.3 * (sum(log_amount) OVER () - log_amount) / (count(*) OVER () - 1) AS sector_blend_loo,
       0.7 * (sum(log_amount) OVER (PARTITION BY region) - log_amount) / NULLIF(count(*) OVER (PARTITION BY region) - 1, 0)
         + 0.3 * (sum(log_amount) OVER () - log_amount) / (count(*) OVER () - 1) AS region_blend_loo,
       {', '.join(roll)},
       CAST(sum(post_policy) OVER (ORDER BY year, deal_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS policy_cumulative
  FROM tagged),
feat AS (SELECT *, sector_code * year AS sector_year_int, region_code * post_policy AS region_policy_int FROM feat0)"""


def with_tagged(body: str, p: Preset = PRESET_A, extra: str = "") -> str:
    ctes = [DEALS, clean(p), tagged(p)] + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_features(body: str, p: Preset = PRESET_A, extra: str = "") -> str:
    ctes = [DEALS, clean(p), tagged(p), features(p)] + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_deals(body: str, extra: str = "") -> str:
    return "WITH " + ",\n".join([DEALS] + ([extra] if extra else [])) + "\n" + body
