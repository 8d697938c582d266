"""Row filters and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Preset


def require_column(df: DataFrame, name: str) -> DataFrame:
    """Fail loudly when a required column is absent."""
    if name not in df.columns:
        raise ValueError(f"required column '{name}' is missing; have {df.columns}")
    return df


def with_optional(df: DataFrame, name: str, dtype: str = "string") -> DataFrame:
    """An optional column that is absent becomes a typed NULL column."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def clean_rows(df: DataFrame, preset: Preset) -> DataFrame:
    """Drop NULL amount/year, keep amount > 0, year truncated to int, year <= max."""
    require_column(df, "amount")
    return (df.where(F.col("amount").isNotNull() & F.col("year").isNotNull() & (F.col("amount") > 0))
            .withColumn("year", F.col("year").cast("int"))
            .where(F.col("year") <= preset.max_year))


def clean_rows_r(df: DataFrame) -> DataFrame:
    """Drop NULL amount/year only (zero and negative amounts stay)."""
    return df.where(F.col("amount").isNotNull() & F.col("year").isNotNull())


def cap_outliers(df: DataFrame, cap: float, positive: bool = False) -> DataFrame:
    """Amount <= cap (box plots) or 0 < amount <= cap (densities)."""
    c = F.col("amount") <= cap
    if positive:
        c = c & (F.col("amount") > 0)
    return df.where(c)


def phase_slice(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Lo <= year <= hi (inclusive)."""
    return df.where(F.col("year").between(lo, hi))


def positive_log10(df: DataFrame, col: str = "amount") -> DataFrame:
    """P5: keep positive values and add their log10."""
    return df.where(F.col(col) > 0).withColumn(f"log10_{col}", F.log10(col))


def isin_top_groups(df: DataFrame, top: DataFrame, col: str) -> DataFrame:
    """Keep rows whose ``col`` is in a computed set (left-semi join; the set
    is broadcast by AQE only once its measured size is under the threshold)."""
    return df.join(top.select(col).distinct(), col, "left_semi")


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where all given columns are non-NULL (and not NaN)."""
    cond = F.lit(True)
    for c in cols:
        t = dict(df.dtypes)[c]
        cc = F.col(c).isNotNull()
        if t in ("double", "float"):
            cc = cc & ~F.isnan(c)
        cond = cond & cc
    return df.where(cond)


def prune_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Project only the needed columns (Catalyst prunes the scan)."""
    return df.select(*cols)


def nonempty_groups(agg: DataFrame, value: str) -> DataFrame:
    """Keep aggregate rows whose value is > 0 (HAVING)."""
    return agg.where(F.col(value) > 0)


def min_group_guard(df: DataFrame, group: str, min_rows: int, level: str | None = None,
                    skip_prefix: str | None = None) -> DataFrame:
    """P10: one row per group with its size and whether it passes the guards:
    rows >= min_rows, >= 2 distinct levels of ``level`` (if given), label not
    starting with ``skip_prefix``."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if level:
        aggs.append(F.countDistinct(level).alias("n_levels"))
    g = df.groupBy(group).agg(*aggs)
    ok = F.col("n_rows") >= min_rows
    if level:
        ok = ok & (F.col("n_levels") >= 2)
    if skip_prefix:
        ok = ok & ~F.col(group).startswith(skip_prefix)
    return g.withColumn("passes", ok)
