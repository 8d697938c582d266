"""Column expressions (all JVM-side, inside whole-stage codegen; no Python UDFs).

Each function returns a ``Column``; none touches data by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (BRI_TOKENS, COUNTRY_MAP, GREENFIELD_TOKENS, MISSING_TOKENS, MONTH_NAMES, Preset)

# Fixed patterns of the two number readers.
STRIP_CHARS = r"[\[\]$,%\s]"
STRICT_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
FIRST_NUMBER = r"([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?)"
R_KEEP = r"[^0-9.,-]"
R_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_number(x) -> Column:
    """strip ``[ ] $ , %`` and white space; a whole number parses directly,
    otherwise the first number inside the text is taken; otherwise NULL."""
    s = F.trim(F.regexp_replace(_c(x).cast("string"), STRIP_CHARS, ""))
    first = F.regexp_extract(s, FIRST_NUMBER, 1)
    return (F.when(s.rlike(STRICT_NUMBER), s.try_cast("double"))
            .when(first != "", first.try_cast("double")))


def clean_number_r(x) -> Column:
    """keep only digits, dot, comma and minus, drop commas, parse, else NULL."""
    s = F.regexp_replace(F.regexp_replace(_c(x).cast("string"), R_KEEP, ""), ",", "")
    return F.when(s.rlike(R_NUMBER), s.try_cast("double"))


def to_year(x) -> Column:
    """numeric coercion of a year-like text; bad -> NULL."""
    s = F.trim(_c(x).cast("string"))
    return F.when(s.rlike(STRICT_NUMBER), s.try_cast("double"))


def log_amount(x) -> Column:
    """natural log (NULL for non-positive input)."""
    return F.when(_c(x) > 0, F.log(_c(x)))


def back_transform(x, floor: float | None = None) -> Column:
    """exp of a log-scale value, optionally floored."""
    e = F.exp(_c(x))
    return F.greatest(e, F.lit(floor)) if floor is not None else e


def post_policy_flag(year, policy_year: int) -> Column:
    """F6"""
    return (_c(year) >= policy_year).cast("int")


def assign_phase(year, preset: Preset) -> Column:
    """label of the phase holding ``year``; outside all phases ``<prefix> (year)``."""
    e = None
    for p in preset.phases:
        cond = (_c(year) >= p.lo) & (_c(year) <= p.hi) if p.hi is not None else _c(year) >= p.lo
        e = F.when(cond, p.label) if e is None else e.when(cond, p.label)
    return e.otherwise(F.concat(F.lit(preset.outside_prefix + " ("), _c(year).cast("string"), F.lit(")")))


def phase_flags(year, preset: Preset, open_last: bool = True) -> list[Column]:
    """F8: one 0/1 column per phase; the last phase has no upper bound (python rule)."""
    out = []
    for i, p in enumerate(preset.phases):
        last = i == len(preset.phases) - 1
        cond = (_c(year) >= p.lo) if (last and open_last) else _c(year).between(p.lo, p.hi)
        out.append(cond.cast("int").alias(f"phase_{i + 1}"))
    return out


def phase_flags_r(year, preset: Preset) -> list[Column]:
    """closed-range phase flags plus the change-strategy flag (R rule)."""
    out = [_c(year).between(p.lo, p.hi).cast("int").alias(f"phase_{i + 1}") for i, p in enumerate(preset.phases)]
    hi = preset.phases[-1].hi
    out.append(_c(year).between(preset.change_year, hi).cast("int").alias("change_flag"))
    return out


def is_greenfield(x, other_label: str = "M&A") -> Column:
    """upper+trim in the greenfield tokens -> 'Greenfield' else ``other_label``;
    a NULL value is not a token (the R rule uses 'Other' as ``other_label``)."""
    return F.when(F.upper(F.trim(_c(x))).isin(GREENFIELD_TOKENS), "Greenfield").otherwise(other_label)


def is_bri(x) -> Column:
    """lower+trim in the BRI tokens -> 'BRI' else 'Others'."""
    return F.when(F.lower(F.trim(_c(x))).isin(BRI_TOKENS), "BRI").otherwise("Others")


def clean_category(x, missing: str = "Missing") -> Column:
    """NULL and the missing tokens -> ``missing``, then strip (two blanks become
    empty, not missing)."""
    c = _c(x).cast("string")
    return F.trim(F.when(c.isNull() | c.isin(MISSING_TOKENS), F.lit(missing)).otherwise(c))


def bin_share(x) -> Column:
    """left-closed bins [0,20) .. [80,100); 100 and above, negatives, NULL -> NULL."""
    v = _c(x)
    return (F.when((v >= 0) & (v < 20), "0-19").when((v >= 20) & (v < 40), "20-39")
            .when((v >= 40) & (v < 60), "40-59").when((v >= 60) & (v < 80), "60-79")
            .when((v >= 80) & (v < 100), "80-99"))


def bin_share_r(x) -> Column:
    """right-closed (-inf,19], (19,39], (39,59], (59,79], (79,inf)."""
    v = _c(x)
    return (F.when(v <= 19, "0-19").when(v <= 39, "20-39").when(v <= 59, "40-59")
            .when(v <= 79, "60-79").when(v.isNotNull(), "80-99"))


def share_bin(x, preset: Preset) -> Column:
    return bin_share(x) if preset.share_rule == "left" else bin_share_r(x)


def bin_year(year, preset: Preset) -> Column:
    """right-closed year bins (lo-1, hi] per phase, label = phase label."""
    e = None
    for p in preset.phases:
        cond = (_c(year) > p.lo - 1) & (_c(year) <= p.hi)
        e = F.when(cond, p.label) if e is None else e.when(cond, p.label)
    return e


def map_country(x) -> Column:
    """F16: fixed name replacement; unmapped names pass through."""
    m = F.create_map(*[F.lit(v) for kv in COUNTRY_MAP.items() for v in kv])
    return F.coalesce(m[_c(x)], _c(x))


def format_money(millions) -> Column:
    """>= 1000 -> '$x.xB' else '$xM' (input in millions)."""
    v = _c(millions)
    return F.when(v >= 1000, F.format_string("$%.1fB", v / 1000)).otherwise(F.format_string("$%.0fM", v))


def phase_label_text(x, prefix: str = "Going_Global", spaced: str = "Going Global ") -> Column:
    """replace the flag-name prefix by its spaced form, delete every '.0', trim
    ('Going_Global1.0' -> 'Going Global 1')."""
    s = F.regexp_replace(_c(x), prefix, spaced)
    s = F.regexp_replace(s, r"\.0", "")
    return F.trim(s)


def phase_label_text_r2(x) -> Column:
    """F20 (second R variant): underscores to blanks ('Going_Global1.0' -> 'Going Global1.0')."""
    return F.regexp_replace(_c(x), "_", " ")


def year_to_date(year) -> Column:
    """F21"""
    return F.make_date(_c(year).cast("int"), F.lit(1), F.lit(1))


def round_label(x) -> Column:
    """round half to even to a whole number."""
    return F.bround(_c(x), 0)


def unknown_level(x, label: str = "Unknown") -> Column:
    """F23"""
    return F.coalesce(_c(x).cast("string"), F.lit(label))


def effect_percent(x) -> Column:
    """(exp(effect) - 1) * 100"""
    return F.expm1(_c(x)) * 100


def replace_values(x, mapping: dict) -> Column:
    """value replacement; unmapped values pass through."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(m[_c(x)], _c(x))


def inf_to_null(x) -> Column:
    """+-infinity (and NaN) -> NULL."""
    v = _c(x)
    return F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v)


def percent_label(p) -> Column:
    """proportion -> text with one decimal and '%'."""
    return F.format_string("%.1f%%", _c(p) * 100)


def month_name(m) -> Column:
    """Calendar name of a 1-12 month number."""
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), _c(m).cast("int"))


def calendar_position(name) -> Column:
    """1-based calendar position of a month name (0 if not a month)."""
    return F.array_position(F.array(*[F.lit(n) for n in MONTH_NAMES]), _c(name))
