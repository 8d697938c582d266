"""Source and sink queries. Each writes a text copy of data Spark derives
from the driver tables into the shared folder and scans it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PRESET_A
from ..operators import reports as R
from ..operators.clean import require_column, with_optional
from ..operators.features import features
from ..operators.ordered import written
from ..session import scratch_path
from ..sources import text as X
from ..sources.deals import deals
from . import sql as Q
from .registry import register

_TEXT_COLS = "deal_id, year, month, investor, amount, share_size, party, sector, subsector, country, region"


def _raw_copy(spark, sf) -> str:
    """Export the deals view with the raw headers (verbatim values)."""
    d = deals(spark, sf)
    raw = d.toDF(*X.RAW_HEADERS)
    return X.write_csv(raw, scratch_path(spark, "deals-csv"))


def _dirty_export(spark, sf, keyless: bool = False) -> str:
    """An export of the deals as files have them: columns in another order, blanks after commas, month names on odd
    keys, share sizes with half points, an unquoted comma in the investor where the deal type is known (one field too
    many), the last fields left out where it isn't (a short line)."""
    d = deals(spark, sf)
    odd = F.col("deal_id") % 2 == 1
    month = F.when(odd, F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMMM")).otherwise(F.col("month").cast("string"))
    share = F.coalesce(F.when(odd, F.concat(F.col("share_size").cast("string"), F.lit(".5"))).otherwise(F.col("share_size").cast("string")), F.lit(""))
    head = ["Investor/Contractor", "Quantity in Millions", "Year", "Month", "Share Size", "Sector", "Transaction Party", "Region", "Country", "Subsector"]
    cells = [F.when(F.col("greenfield").isNull(), F.col("investor")).otherwise(F.concat("investor", F.lit(", "), F.col("country"))),
             F.col("amount").cast("string"), F.col("year").cast("string"), month, share, F.col("sector"), F.coalesce("party", F.lit("")), F.col("region"), F.col("country"), F.col("subsector")]
    if not keyless:
        head, cells = ["deal_id", *head], [F.col("deal_id").cast("string"), *cells]
    short = F.col("greenfield").isNull()
    line = F.concat(F.concat_ws(", ", *cells), F.when(short, F.lit("")).otherwise(F.concat(F.lit(", "), F.col("greenfield"), F.lit(", "), F.col("bri"))))
    path = scratch_path(spark, "export")
    names = ", ".join([*head, "Greenfield", "BRI"])
    # a one-column table whose column name is the header line: every file starts with it, no field is quoted
    d.select(line.alias(names)).write.mode("overwrite").option("header", True).option("sep", "\u0001").option("quote", "\u0000") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_TYPED = """SELECT {key}year, month, CASE WHEN greenfield IS NULL THEN investor ELSE investor || ',' || country END AS investor, amount,
  CAST(share_size AS DOUBLE) + CASE WHEN deal_id % 2 = 1 THEN 0.5 ELSE 0 END AS share_size, party, sector, subsector, country, region,
  CASE WHEN greenfield IS NOT NULL THEN NULLIF(ltrim(bri), '') END AS bri, NULLIF(ltrim(greenfield), '') AS greenfield,
  CASE WHEN greenfield IS NULL THEN -2 ELSE 1 END AS _ragged FROM deals"""


@register("scan_deals_csv", Q.with_deals(_TYPED.format(key="deal_id, ")))
def q_scan_deals_csv(spark, sf):
    """S1+S2+S4+S5: an export in another column order with surplus, short, fractional-share and month-name lines, bound
    by header name, repaired, renamed and typed."""
    raw = X.scan_export(spark, _dirty_export(spark, sf))
    return X.type_deals(raw).drop("_lines", "_bad_bytes")


@register("scan_keyless_csv", Q.with_deals(_TYPED.format(key="")))
def q_scan_keyless_csv(spark, sf):
    """S1 without a key column: every line gets a derived id; it depends on the files' split, so it is left out here."""
    raw = X.scan_export(spark, _dirty_export(spark, sf, keyless=True))
    return X.type_deals(raw).drop("deal_id", "_lines", "_bad_bytes")


def _broken_export(spark, sf) -> str:
    """An export whose investor field is quoted and holds a line break and quotes on every third key, and bytes that are no
    UTF-8 on every seventh; keys and amounts that can't be read on every eleventh and thirteenth."""
    d, k = deals(spark, sf), F.col("deal_id")
    name = F.concat(F.col("investor"), F.when(k % 7 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise(F.lit("")))
    quoted = F.concat(F.lit('"'), name, F.lit('\n\n""of"", '), F.col("country"), F.lit('"'))
    cells = [F.when(k % 11 == 0, F.concat(F.lit("no "), k.cast("string"))).otherwise(k.cast("string")), F.when(k % 3 == 0, quoted).otherwise(name),
             F.when(k % 13 == 0, F.lit("n/a")).otherwise(F.col("amount").cast("string")), F.col("year").cast("string"), F.col("sector")]
    path = scratch_path(spark, "broken")
    head = spark.createDataFrame([("deal_id,Investor/Contractor,Quantity in Millions,Year,Sector",)], "value string").coalesce(1)
    head.union(d.select(F.concat_ws(",", *cells).alias("value"))).write.mode("overwrite").text(path)
    return path


#: The broken export is read in so many splits, as long as they are no smaller and no larger than these bounds (bytes).
_SPLITS, _SMALL_SPLIT, _LARGE_SPLIT = 256, 32 << 10, 128 << 20


def _split_bytes(spark, path: str) -> int:
    """The split size for an export: small enough that records cross splits, and a number of splits that doesn't grow with it."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return min(max(size // _SPLITS, _SMALL_SPLIT), _LARGE_SPLIT)


def _broken_records(spark, sf):
    """The export's records, read in small splits (files of this size would be one split each) and written once."""
    path = _broken_export(spark, sf)
    conf, key = spark.conf, "spark.sql.files.maxPartitionBytes"
    had = conf.get(key)
    conf.set(key, str(_split_bytes(spark, path)))
    try:
        return written(X.scan_export(spark, path), "broken-records")
    finally:
        conf.set(key, had)


_BROKEN = """SELECT CASE WHEN deal_id % 11 <> 0 THEN deal_id END AS deal_id, year, CASE WHEN deal_id % 13 <> 0 THEN amount END AS amount, sector,
  investor || CASE WHEN deal_id % 7 = 0 THEN chr(65533) ELSE '' END || CASE WHEN deal_id % 3 = 0 THEN chr(10) || chr(10) || '"of", ' || country ELSE '' END AS investor,
  CASE WHEN deal_id % 3 = 0 THEN 3 ELSE 1 END AS _lines, deal_id % 7 = 0 AS _bad_bytes, deal_id % 11 = 0 OR deal_id % 13 = 0 AS _rejected FROM deals"""


@register("scan_quoted_breaks", Q.with_deals(f"SELECT deal_id, year, amount, sector, investor, CAST(_lines AS BIGINT) AS _lines, _bad_bytes FROM ({_BROKEN})"))
def q_scan_quoted_breaks(spark, sf):
    """S1+S2: records with quoted line breaks over the borders of splits and with undecodable bytes."""
    raw = _broken_records(spark, sf)
    return X.type_deals(raw).select("deal_id", "year", "amount", "sector", "investor", "_lines", "_bad_bytes")


@register("scan_counts", Q.with_deals(f"""SELECT count(*) AS records, CAST(0 AS BIGINT) AS folded, CAST(0 AS BIGINT) AS padded, count(*) FILTER (_lines > 1) AS broken,
  count(*) FILTER (_bad_bytes) AS undecodable, count(*) FILTER (_rejected) AS rejected FROM ({_BROKEN})"""))
def q_scan_counts(spark, sf):
    """How many records were repaired, broken over lines, undecodable and rejected."""
    return X.scan_counts(_broken_records(spark, sf))


@register("scan_repairs", Q.with_deals("""SELECT count(*) AS records, count(greenfield) AS folded, count(*) - count(greenfield) AS padded,
  CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS undecodable, CAST(0 AS BIGINT) AS rejected FROM deals"""))
def q_scan_repairs(spark, sf):
    """D7 on the export with surplus and short lines."""
    return X.scan_counts(X.scan_export(spark, _dirty_export(spark, sf)))


@register("scan_all_string", Q.with_deals("""SELECT CAST(deal_id AS VARCHAR) AS deal_id, CAST(year AS VARCHAR) AS year,
  investor, CAST(amount AS VARCHAR) AS amount, sector FROM deals"""))
def q_scan_all_string(spark, sf):
    """S3: every column as text."""
    path = _raw_copy(spark, sf)
    raw = X.rename_columns(X.normalize_headers(X.scan_csv(spark, path, X.RAW_HEADERS)))
    return raw.select("deal_id", "year", "investor", "amount", "sector")


@register("normalize_headers", Q.with_deals(f"SELECT {_TEXT_COLS} FROM deals"))
def q_normalize_headers(spark, sf):
    """S4 (R rule: white-space runs -> '.') then S5 with the dotted names."""
    path = _raw_copy(spark, sf)
    raw = X.normalize_headers(X.scan_csv(spark, path, X.RAW_HEADERS), rule="r")
    m = {X.normalize_header(h, "r"): X.CANONICAL[X.normalize_header(h)] for h in X.RAW_HEADERS}
    d = X.type_deals(X.rename_columns(raw, m)).withColumn("share_size", F.col("share_size").cast("int"))
    return d.select(*[c.strip() for c in _TEXT_COLS.split(",")])


@register("rename_columns", Q.with_deals("SELECT deal_id, investor, amount, greenfield FROM deals"))
def q_rename_columns(spark, sf):
    """Source names -> canonical names (verbatim parquet copy, no text step)."""
    d = deals(spark, sf).toDF(*[X.normalize_header(h) for h in X.RAW_HEADERS])
    return X.rename_columns(d).select("deal_id", "investor", "amount", "greenfield")


@register("scan_ragged_csv", Q.with_deals("""SELECT deal_id,
  CASE WHEN greenfield IS NULL THEN investor ELSE investor || ',' || country END AS investor, amount,
  sector, NULLIF(ltrim(bri), '') AS bri, NULLIF(ltrim(greenfield), '') AS greenfield,
  CASE WHEN greenfield IS NULL THEN -1 ELSE 1 END AS _ragged FROM deals"""))
def q_scan_ragged_csv(spark, sf):
    """A hand-written export: where the deal type is known the investor field
    holds an unquoted comma (one surplus field); where it is unknown the trailing
    field is omitted (short row). The line parser folds the surplus back and pads
    the short rows."""
    d = deals(spark, sf)
    names = ["deal_id", "amount", "investor", "sector", "bri", "greenfield"]
    line = F.concat_ws(",", F.col("deal_id").cast("string"), F.col("amount").cast("string"),
                       F.when(F.col("greenfield").isNull(), F.col("investor"))
                       .otherwise(F.concat(F.col("investor"), F.lit(","), F.col("country"))), "sector", "bri",
                       F.col("greenfield"))
    path = scratch_path(spark, "ragged")
    d.select(line.alias("value")).write.mode("overwrite").text(path)
    r = X.scan_ragged_csv(spark, path, names, fold="investor")
    return r.select(F.col("deal_id").cast("long").alias("deal_id"), "investor",
                    F.col("amount").cast("double").alias("amount"), "sector", "bri", "greenfield", "_ragged")


@register("require_column", Q.with_deals("SELECT deal_id, amount, CAST(NULL AS INT) AS share_size FROM deals"))
def q_require_column(spark, sf):
    """The amount column is required; an absent optional column is NULL."""
    d = require_column(deals(spark, sf).drop("share_size"), "amount")
    return with_optional(d, "share_size", "int").select("deal_id", "amount", "share_size")


_SECT = Q.phases_values(PRESET_A)


@register("sink_report", Q.with_tagged(
    "SELECT p.label AS phase, sector, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total "
    "FROM tagged JOIN phases p ON year BETWEEN p.lo AND p.hi GROUP BY 1, 2", PRESET_A, _SECT))
def q_sink_report(spark, sf):
    """A report written as CSV with header and read back."""
    rep = R.sector_total_by_phase(features(spark, sf, PRESET_A), PRESET_A)
    path = X.write_csv(rep, scratch_path(spark, "report"))
    back = X.scan_csv(spark, path, ["phase", "sector", "total"])
    return back.select("phase", "sector", F.col("total").cast("double").alias("total"))


@register("sink_text_summary", Q.with_tagged("""
SELECT phase, parameter, value FROM (UNPIVOT (
  SELECT phase, CAST(count(*) AS DOUBLE) AS n_obs, round(avg(log_amount), 6) AS mean_log,
         CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total FROM tagged GROUP BY phase)
  ON n_obs, mean_log, total INTO NAME parameter VALUE value)"""))
def q_sink_text_summary(spark, sf):
    """S8 (re-aimed): a summary as a (key, parameter, value) table, written as parquet
    and read back."""
    summ = R.phase_summary(features(spark, sf, PRESET_A))
    t = X.as_parameter_table(summ, ["phase"])
    path = X.write_parquet(t, scratch_path(spark, "summary"))
    return spark.read.parquet(path)
