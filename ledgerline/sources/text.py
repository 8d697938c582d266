"""Text sources and sinks: delimited scans (S1-S6) and report sinks.

All scans use a fixed all-string read schema (no inference pass over the data) and
type columns afterwards with the cleaning expressions.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import written

# Raw export headers (fixed) and their canonical names.
RAW_HEADERS = ["deal_id", "Year", "Month", "Investor/Contractor", "Quantity in Millions", "Share Size",
               "Transaction Party", "Sector", "Subsector", "Country", "Region", "BRI", "Greenfield"]
CANONICAL = {
    "deal_id": "deal_id", "Year": "year", "Month": "month", "Investor_Contractor": "investor",
    "Quantity_in_Millions": "amount", "Share_Size": "share_size", "Transaction_Party": "party",
    "Sector": "sector", "Subsector": "subsector", "Country": "country", "Region": "region",
    "BRI": "bri", "Greenfield": "greenfield",
}


def normalize_header(name: str, rule: str = "python") -> str:
    """Python rule strips, turns '/' and blanks into '_'; R rule turns each
    white-space run into '.'."""
    if rule == "r":
        return re.sub(r"\s+", ".", name)
    return re.sub(r" ", "_", name.strip().replace("/", "_"))


def normalize_headers(df: DataFrame, rule: str = "python") -> DataFrame:
    """S4 on a frame's column names (metadata only)."""
    return df.toDF(*[normalize_header(c, rule) for c in df.columns])


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """S5"""
    mapping = mapping or CANONICAL
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def all_string_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def scan_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """S3: header row, comma, utf-8, blanks after a delimiter skipped, every column read as text and bound by
    position to ``names`` (no inference job). For files whose columns are known; exports go through scan_export."""
    return (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", False).option("encoding", "UTF-8").option("escape", '"')
            .option("mode", "PERMISSIVE").schema(all_string_schema(names)).csv(path))


#: Lines of one record; a quoted field that runs on for more is taken for a stray quote.
MOST_LINES = 10_000


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines in parallel: file, block (where its split starts in the file), line (ascending in a block), value with
    undecodable bytes replaced, and bad_bytes, whether there were any."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("line", F.monotonically_increasing_id())
    text = F.make_valid_utf8("value")
    return raw.select("file", "block", "line", F.when(text.endswith("\r"), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text).alias("value"),
                      (~F.is_valid_utf8("value")).alias("bad_bytes"))


def quoted_records(lines: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """Records of a quoted export: file, block, line (of its first line), value, lines (how many), bad_bytes.

    A line starts a record if an even number of quotes stands before it in its file. Quotes are counted per split, a prefix
    parity over the splits of a file says which of them start inside a quoted field, and only splits with a line break in
    quotes are looked at line by line; all other lines pass as they are. A record that would have more than ``most`` lines
    is a stray quote: its lines are records of their own. Lines of busy splits are put in order and written once; the table
    of splits is small (one row each) and broadcast, that of stray records has at most one row per ``most`` lines.
    """
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    d = lines.withColumn("odd", quotes)
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("file", "block").agg(F.sum("odd").alias("odds")) \
        .withColumn("open", F.coalesce(F.sum("odds").over(by_file), F.lit(0)) % 2)
    d = d.join(F.broadcast(blocks), ["file", "block"])
    plain = (F.col("odds") == 0) & (F.col("open") == 0)
    single = d.where(plain).select("file", "block", "line", "value", F.lit(1).cast("long").alias("lines"), "bad_bytes")
    within = Window.partitionBy("file", "block").orderBy("line")
    before = F.col("open") + F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.struct("block", "line")
    busy = d.where(~plain).withColumn("top", F.when(before % 2 == 0, here))
    busy = written(busy.select("file", "block", "line", "value", "bad_bytes", "top", F.last("top", ignorenulls=True).over(
        within.rowsBetween(Window.unboundedPreceding, 0)).alias("start")), "busy-lines")
    carried = busy.groupBy("file", "block").agg(F.max("top").alias("top")) \
        .select("file", "block", F.last("top", ignorenulls=True).over(by_file).alias("carried"))
    busy = busy.drop("top").join(F.broadcast(carried), ["file", "block"]).withColumn("start", F.coalesce("start", "carried", here))
    strays = busy.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > most).select("file", "start", F.lit(True).alias("stray"))
    # a record's lines meet once, in one task; those of a stray quote are grouped by line there
    part = F.struct("block", "line", "value")
    alone = F.when(F.col("stray"), F.col("line")).alias("alone")
    whole = busy.join(strays, ["file", "start"], "left").groupBy("file", "start", alone).agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.count(F.lit(1)).alias("lines"), F.bool_or("bad_bytes").alias("bad_bytes"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return single.unionByName(whole.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"),
                                           joined.alias("value"), "lines", "bad_bytes"))


def _split_fields(line: Column) -> Column:
    """Fields of one record: quoted (a doubled quote stands for one) or up to the next comma, leading blanks skipped.
    Records without a quote are split at commas; the others take one pass of a pattern."""
    parts = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'[ \t]*("(?:[^"]|"")*"|[^,]*),'), 1)
    quoted = F.transform(parts, lambda p: F.when(
        p.rlike('^"(?s:.*)"$') & (F.length(p) > 1), F.replace(p.substr(F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(F.ltrim(line, F.lit(" \t")), ",[ \t]*"))


def _fields(lines: DataFrame, names: list[str], fold: str, *keep: str) -> DataFrame:
    """Lines (column ``value``) to text columns ``names``: a line with n fields is taken as it is, a longer one folds
    its surplus fields into column ``fold`` (re-joined with commas, D7), a shorter one is padded with NULL. Adds
    ``_ragged``: 0 exact, +k folded, -k missing. Empty fields are NULL."""
    n, k = len(names), names.index(fold) + 1
    d = lines.select(*keep, _split_fields(F.col("value")).alias("f"))
    extra = F.size("f") - n
    folded = F.when(extra > 0, F.concat(
        F.slice("f", 1, k - 1), F.array(F.array_join(F.slice("f", F.lit(k), extra + 1), ",")),
        F.slice("f", F.lit(k) + extra + 1, F.lit(n)))).otherwise(F.col("f"))
    d = d.select(*keep, folded.alias("g"), extra.alias("_ragged"))
    cells = [F.try_element_at("g", F.lit(i + 1)) for i in range(n)]
    return d.select(*keep, *[F.when(c != "", c).alias(nm) for c, nm in zip(cells, names)], "_ragged")


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of the export's first file by name that has one (tiny jobs)."""
    for name in sorted(spark.read.text(path).inputFiles()):
        row = spark.read.text(name).first()
        if row:
            return row["value"].lstrip("\ufeff")
    return ""


def split_header(line: str) -> list[str]:
    return next(csv.reader([line], skipinitialspace=True), [])


def scan_ragged_csv(spark: SparkSession, path: str, names: list[str] | None = None, fold: str | None = None) -> DataFrame:
    """One record per line (a quoted field may hold line breaks), blank and header lines dropped, undecodable bytes
    replaced. ``names`` are read from the header if absent; ``fold`` is the column that takes surplus fields (default: the investor column, by whatever name it has)."""
    if names is None:
        head = header_line(spark, path)
        names = split_header(head)
    else:
        head = ",".join(names)
    if fold is None:
        fold = next((c for c in names if CANONICAL.get(normalize_header(c)) == "investor"
                     or normalize_header(c).lower().startswith("investor")), None)
        if fold is None:
            raise ValueError(f"no column to fold surplus fields into: {names}")
    return _fields(_data_records(spark, path, head), names, fold)


def _data_records(spark: SparkSession, path: str, head: str) -> DataFrame:
    return quoted_records(scan_lines(spark, path)).where((F.trim("value") != "") & (F.ltrim(F.col("value"), F.lit("\ufeff")) != head))


def scan_export(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2 + S4 + S5: an export with a header, columns bound by name whatever their order.

    Lines with as many fields as the header are read strictly; all others go through the ragged repair and are marked
    in ``_ragged``, so nothing is dropped without a count (see scan_counts). Known headers get their canonical names,
    unknown ones keep their normalised name, absent canonical columns are NULL; the amount column is required. A file
    without deal_id gets one from (partition, line), the same for the same files and split size. A quoted field may hold
    line breaks, also over the border of two splits; undecodable bytes are replaced. ``_lines`` and ``_bad_bytes`` say
    which records that touched."""
    head = header_line(spark, path)
    names = [CANONICAL.get(normalize_header(c), normalize_header(c)) for c in split_header(head)]
    if "amount" not in names:
        raise ValueError(f"the export has no amount column: {names}")
    if len(set(names)) != len(names):
        raise ValueError(f"repeated column names: {names}")
    lines = _data_records(spark, path, head).withColumnsRenamed({"line": "_line", "lines": "_lines", "bad_bytes": "_bad_bytes"})
    d = _fields(lines, names, "investor" if "investor" in names else names[-1], "_line", "_lines", "_bad_bytes")
    if "deal_id" not in names:
        d = d.withColumn("deal_id", F.col("_line").cast("string"))
    absent = [c for c in CANONICAL.values() if c not in d.columns]
    return d.drop("_line").withColumns({c: F.lit(None).cast("string") for c in absent})


def scan_counts(raw: DataFrame) -> DataFrame:
    """Records, those folded, padded, of several lines and with undecodable bytes, and those whose key or amount can't be
    read."""
    from ..functions.scalar import clean_number
    return raw.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("_ragged") > 0).alias("folded"),
                   F.count_if(F.col("_ragged") < 0).alias("padded"), F.count_if(F.col("_lines") > 1).alias("broken"), F.count_if("_bad_bytes").alias("undecodable"),
                   F.count_if(F.col("deal_id").try_cast("long").isNull() | clean_number("amount").isNull()).alias("rejected"))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december")


def month_number(col: str) -> Column:
    """1-12 from a number or an English month name (any case, three letters or more)."""
    text = F.lower(F.trim(F.col(col)))
    e = F.when(text.rlike("^[0-9]+([.]0*)?$"), text.cast("double").cast("int"))
    for i, m in enumerate(MONTHS, start=1):
        e = e.when((F.length(text) >= 3) & F.lit(m).startswith(text), i)
    return e


def type_deals(raw: DataFrame) -> DataFrame:
    """Typed projection of an all-text deals frame (canonical names); empty text fields become NULL, share sizes keep
    their decimals, months may be numbers or names."""
    from ..functions.scalar import clean_number, to_year

    def txt(c):
        return F.when(F.col(c) != "", F.col(c)).alias(c)
    return raw.select(
        F.col("deal_id").try_cast("long").alias("deal_id"),
        to_year("year").cast("int").alias("year"),
        month_number("month").alias("month"),
        txt("investor"),
        clean_number("amount").alias("amount"),
        clean_number("share_size").alias("share_size"),
        *[txt(c) for c in ("party", "sector", "subsector", "country", "region", "bri", "greenfield")],
        *[c for c in ("_ragged", "_lines", "_bad_bytes") if c in raw.columns])


def write_csv(df: DataFrame, path: str) -> str:
    """report/table as CSV with a header row (values kept verbatim)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    """Parquet sink."""
    df.write.mode("overwrite").parquet(path)
    return path


def as_parameter_table(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """S8 (re-aimed): a fitted-summary frame as (keys..., parameter, value) rows."""
    vals = [c for c, t in df.dtypes if c not in key_cols and t in ("double", "float", "int", "bigint", "long")]
    return df.select(*key_cols, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
        key_cols, vals, "parameter", "value")
