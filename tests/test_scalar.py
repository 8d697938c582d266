"""Edge rules of the scalar functions (FIXTURES.md section 4)."""
import pytest
from pyspark.sql import functions as F

from ledgerline.config import PRESET_A, PRESET_B, PUBLISHED
from ledgerline.functions import scalar as S


def col_values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


NUMBERS = [("$1,230.5", 1230.5, 1230.5), ("[45]%", 45.0, 45.0), ("(7)", 7.0, 7.0), ("approx 1e3 x", 1000.0, 13.0),
           ("5.", 5.0, 5.0), (".5", 0.5, 0.5), ("1-2", 1.0, None), ("1.2.3", 1.2, None), ("0x1p3", 0.0, 13.0),
           ("nan", None, None), ("", None, None), ("-", None, None), ("abc", None, None), (None, None, None)]


def test_clean_number_rules(spark):
    xs = [(r[0],) for r in NUMBERS]
    a = col_values(spark, xs, S.clean_number("x"))
    b = col_values(spark, xs, S.clean_number_r("x"))
    assert a == [r[1] for r in NUMBERS]
    assert b == [r[2] for r in NUMBERS]


def test_share_bins(spark):
    vals = [0.0, 19.0, 19.5, 20.0, 79.5, 100.0, -1.0, None]
    a = col_values(spark, [(v,) for v in vals], S.bin_share("x"), "x double")
    b = col_values(spark, [(v,) for v in vals], S.bin_share_r("x"), "x double")
    assert a == ["0-19", "0-19", "0-19", "20-39", "60-79", None, None, None]
    assert b == ["0-19", "0-19", "20-39", "20-39", "80-99", "80-99", "0-19", None]


def test_clean_category(spark):
    vals = [None, "nan", "None", "", " ", "  ", " Energy "]
    assert col_values(spark, [(v,) for v in vals], S.clean_category("x")) == \
        ["Missing", "Missing", "Missing", "Missing", "Missing", "", "Energy"]


def test_flags(spark):
    vals = ["G", "greenfield ", "bri", "1", "y", " YES", "Sim", "TRUE", "0", "", None, "M&A"]
    g = col_values(spark, [(v,) for v in vals], S.is_greenfield("x"))
    b = col_values(spark, [(v,) for v in vals], S.is_bri("x"))
    gy = [True, True, False, True, True, True, True, True, False, False, False, False]
    by = [False, False, True, True, True, True, True, True, False, False, False, False]
    assert g == ["Greenfield" if t else "M&A" for t in gy]
    assert b == ["BRI" if t else "Others" for t in by]


def test_phase_years(spark):
    years = [2004, 2005, 2011, 2012, 2013, 2016, 2017, 2024]
    a = col_values(spark, [(y,) for y in years], S.assign_phase("x", PUBLISHED), "x int")
    assert a == ["Fora (2004)", "GG_1.0", "GG_1.0", "GG_1.0", "GG_2.0", "GG_2.0", "GG_3.0_ERP", "GG_3.0_ERP"]
    df = spark.createDataFrame([(y,) for y in [1994, 1995, 1997, 1998, 2001, 2003]], "x int")
    got = [tuple(r) for r in df.select(*S.phase_flags("x", PRESET_A)).collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]  # last phase open
    got_b = [tuple(r) for r in df.select(*S.phase_flags_r("x", PRESET_B)).collect()]
    assert got_b[-1] == (0, 0, 0, 0) and got_b[1] == (1, 0, 0, 0)


def test_phase_label_text(spark):
    v = col_values(spark, [("Going_Global1.0",), ("Going_Global3.0",)], S.phase_label_text("x"))
    assert v == ["Going Global 1", "Going Global 3"]


def test_money_and_percent(spark):
    assert col_values(spark, [(1500.0,), (250.4,)], S.format_money("x"), "x double") == ["$1.5B", "$250M"]
    assert col_values(spark, [(0.1234,)], S.percent_label("x"), "x double") == ["12.3%"]
    assert col_values(spark, [(2.5,), (3.5,)], S.round_label("x"), "x double") == [2.0, 4.0]


def test_inf_to_null(spark):
    v = col_values(spark, [(1.0,), (float("inf"),), (float("-inf"),)], S.inf_to_null("x"), "x double")
    assert v == [1.0, None, None]
