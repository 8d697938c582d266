"""Ragged text scan (FIXTURES csv_rows) and header normalisation."""
from pyspark.sql import functions as F

from ledgerline.session import scratch_path
from ledgerline.sources import text as X


def test_ragged_lines(spark):
    lines = ["a,b,investor/x,d",
             "1,2,inv,4",                 # exact
             "1,2",                       # short -> padded
             "1,2,inv,extra,4",           # one surplus field folds into column 3
             "   ",                       # blank line skipped
             '1,"2,5",inv,4',             # quoted field holding a comma
             "1, 2, inv, 4"]              # blanks after commas skipped
    path = scratch_path(spark, "ragged-test")
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    names = [X.normalize_header(h) for h in lines[0].split(",")]
    assert names == ["a", "b", "investor_x", "d"]
    got = [tuple(r) for r in X.scan_ragged_csv(spark, path, ["a", "b", "investor/x", "d"]).collect()]
    assert ("1", "2", "inv", "4", 0) in got
    assert ("1", "2", None, None, -2) in got
    assert ("1", "2", "inv,extra", "4", 1) in got
    assert ("1", "2,5", "inv", "4", 0) in got
    assert sum(1 for r in got if r == ("1", "2", "inv", "4", 0)) == 2
    assert len(got) == 5


def test_header_rules():
    assert X.normalize_header(" Quantity in Millions ") == "Quantity_in_Millions"
    assert X.normalize_header("Share  Size", "r") == "Share.Size"


def test_csv_round_trip_types_and_empty_text(spark):
    from pyspark.sql import functions as F
    rows = [(1, 2001, 3, "inv a", "$1,250.50", "45%", "", "S", "ss", "C", "R", " bri ", "G")]
    raw = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(13))).toDF(*X.RAW_HEADERS)
    raw = raw.withColumn("deal_id", F.col("deal_id").cast("string"))
    path = X.write_csv(raw, scratch_path(spark, "rt"))
    back = X.type_deals(X.rename_columns(X.normalize_headers(X.scan_csv(spark, path, X.RAW_HEADERS)))).first()
    assert back["deal_id"] == 1 and back["year"] == 2001 and back["month"] == 3
    assert back["amount"] == 1250.5 and back["share_size"] == 45
    assert back["party"] is None          # empty text -> NULL
    assert back["bri"] == "bri "          # blanks after the delimiter skipped


def _export(spark, lines):
    path = scratch_path(spark, "probe")
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    return path


def test_surplus_field_goes_to_the_investor_by_name(spark):
    head = ",".join(X.RAW_HEADERS)
    path = _export(spark, [head, "1,2005,January,CNPC, Ltd,1230,79.5,P,S,SS,C,R,y,G", '2,2006,2,"A ""B"", C",5,19.5,P,S,SS,C,R,y,G', "x,2006,2,A,,1"])
    rows = {r.investor: r for r in X.type_deals(X.scan_export(spark, path)).collect()}
    a = rows["CNPC, Ltd"] if "CNPC, Ltd" in rows else rows["CNPC,Ltd"]
    assert (a.month, a.amount, a.share_size, a._ragged, a.greenfield) == (1, 1230.0, 79.5, 1, "G")
    b = rows['A "B", C']
    assert (b.month, b.share_size, b._ragged) == (2, 19.5, 0)
    c = X.scan_counts(X.scan_export(spark, path)).first()
    assert tuple(c) == (3, 1, 1, 0, 0, 1)


def test_columns_bind_by_header_and_keyless_files_get_ids(spark):
    path = _export(spark, ["Sector, Quantity in Millions, Year, Extra", "S1, $5.5, 2007, e", "S2, 7, 2008, f", "S2, 7, 2008, f"])
    raw = X.scan_export(spark, path)
    assert "Extra" in raw.columns
    rows = X.type_deals(raw).orderBy("year").collect()
    assert [(r.sector, r.amount, r.year, r.investor) for r in rows] == [("S1", 5.5, 2007, None), ("S2", 7.0, 2008, None), ("S2", 7.0, 2008, None)]
    assert len({r.deal_id for r in rows}) == 3
    import pytest
    with pytest.raises(ValueError):
        X.scan_export(spark, _export(spark, ["a,b", "1,2"]))


def _plain_records(raw: bytes):
    """Records of a whole file read at once."""
    out, held = [], []
    for line in raw.decode("utf-8", "replace").split("\n"):
        held.append(line.removesuffix("\r"))
        if "\n".join(held).count('"') % 2 == 0:
            out.append("\n".join(held))
            held = []
    return out


def test_records_over_split_borders(spark, tmp_path):
    import random
    rng = random.Random(3)
    for seed in range(3):
        rows = []
        for i in range(400):
            cell = "".join(rng.choice(['x', ' ', '""', ',', '\n', '\r\n', 'é', '日']) for _ in range(rng.choice([0, 3, 30, 200 if i % 97 == 0 else 5])))
            rows.append(f'{i},"{cell}",end' if rng.random() < 0.5 else f"{i},plain,end")
        raw = "\n".join(rows).encode() + b"\n400,bad \xff\xfe bytes,end"
        path = tmp_path / f"f{seed}.csv"
        path.write_bytes(raw)
        for size in ("64", "700", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                got = X.quoted_records(X.scan_lines(spark, str(path))).collect()
                splits = len({r.block for r in X.scan_lines(spark, str(path)).select("block").distinct().collect()})
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert sorted(r.value for r in got) == sorted(_plain_records(raw))
            assert sum(r.lines for r in got) == raw.count(b"\n") + 1 and sum(r.bad_bytes for r in got) == 1
            assert splits > 5 or size == "100000"


def test_a_stray_quote_does_not_swallow_the_file(spark, tmp_path):
    path = tmp_path / "stray.csv"
    path.write_text("\n".join(["a,b", '1,5" pipe', *[f"{i},x" for i in range(50)]]))
    got = X.quoted_records(X.scan_lines(spark, str(path)), most=20).collect()
    assert len(got) == 52 and all(r.lines == 1 for r in got)
    assert X.quoted_records(X.scan_lines(spark, str(path)).limit(0)).count() == 0


def test_broken_export_is_read_in_a_bounded_number_of_splits(spark, tmp_path):
    from ledgerline.plans import catalog_sources as C
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    spark.range(1000).select(F.lit("x" * 40).alias("value")).coalesce(1).write.text(small)
    spark.range(500_000).select(F.lit("x" * 40).alias("value")).coalesce(1).write.text(large)
    assert C._split_bytes(spark, small) == C._SMALL_SPLIT
    assert C._split_bytes(spark, large) == 500_000 * 41 // C._SPLITS  # 32 KB splits would be 626
