"""Hand-written cases of FIXTURES.md section 3 for the text functions."""

import math

import pytest
from pyspark.sql import functions as F

from quotaflow.functions import text as T


def one(spark, col_fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def test_parse_or_zero(spark):
    vals = ["R$ 163,34", "1.234.567,89", "8,06%", "8.50", "-R$ 10,00", "1 234,5", "", None, "12d",
            "1_000", "nan", "1,2,3"]
    got = one(spark, T.parse_or_zero, vals)
    want = [163.34, 1234567.89, 8.06, 850.0, -10.0, 1234.5, 0.0, 0.0, 0.0, 1000.0, float("nan"), 0.0]
    for g, w in zip(got, want):
        assert (math.isnan(g) and math.isnan(w)) or g == pytest.approx(w)


def test_parse_or_null(spark):
    got = one(spark, T.parse_or_null, ["R$ 163,34", "", "1 234,5", "12d", None])
    assert got[0] == pytest.approx(163.34)
    assert got[1:] == [None, None, None, None]


def test_parse_strict(spark):
    assert one(spark, T.parse_strict, ["R$ 1.234,50"])[0] == pytest.approx(1234.5)
    for bad in ["8%", ""]:
        with pytest.raises(Exception):
            one(spark, T.parse_strict, [bad])


def test_fmt_currency(spark):
    got = one(spark, T.fmt_currency, [1234567.895, -0.001, 2.675, 0.125], "double")
    assert got == ["R$ 1.234.567,90", "R$ -0,00", "R$ 2,67", "R$ 0,12"]


def test_fmt_percent(spark):
    assert one(spark, T.fmt_percent, [0.0806, 12.345], "double") == ["8,06%", "1234,50%"]


def test_valid_ticker(spark):
    got = one(spark, T.is_valid_ticker, ["HGLG11", "ABCD11B", "ABC11", "ABCD12", "ABCD11C"])
    assert got == [True, True, False, False, False]


def test_segment(spark):
    got = one(spark, T.segment, ["Logística", "Híbrido", "Ações", None])
    assert got == ["Tijolo", "Tijolo", "Papéis", "Papéis"]


def test_scale_dy(spark):
    assert one(spark, T.scale_dy, [8.06, 2.0, 1.5], "double") == pytest.approx([0.0806, 2.0, 1.5])


def test_sector_default(spark):
    assert one(spark, T.sector_or_default, ["  ", "NaN", " Logística "]) == ["Indefinido", "Indefinido", "Logística"]


def test_month_label(spark):
    df = spark.createDataFrame([("2024-06-15",)], "d string").select(T.month_label(F.col("d").cast("date")))
    assert df.first()[0] == "Junho / 2024"


def test_masked(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert df.select(T.masked(T.fmt_currency(F.col("x")), True)).first()[0] == "••••••"
    assert df.select(T.masked(T.fmt_currency(F.col("x")), False)).first()[0] == "R$ 1,00"


def test_strip_fences(spark):
    assert one(spark, T.strip_fences, ["```html<p>a</p>```"]) == ["<p>a</p>"]


def test_series_name(spark):
    got = one(spark, lambda c: T.series_name(c), ["^BVSP", "IFIX.SA", "HGLG11.SA"])
    assert got == ["IBOVESPA", "IFIX", "HGLG11"]


def test_strip_and_key_unicode_blanks(spark):
    got = one(spark, T.strip_py, ["\xa0 ABC 　", "  x  ", "\tabc", "", None, "a b"])
    assert got == ["ABC", "x", "abc", "", None, "a b"]
    assert one(spark, T.clean_key, [" hglg11 "]) == ["HGLG11"]


def test_normalize_sector_decomposed_and_precomposed(spark):
    import unicodedata
    dec = unicodedata.normalize("NFD", "Logística Híbrido")
    got = one(spark, T.normalize_sector, ["Logística Híbrido", dec, " ações ", "", None])
    assert got == ["LOGISTICA HIBRIDO", "LOGISTICA HIBRIDO", "ACOES", "", ""]


def test_staged_parsers_equal_column_parsers(spark):
    vals = ["R$ 163,34", "1.234.567,89", "8,06%", "8.50", "-R$ 10,00", "1 234,5", "", None, "12d",
            "1_000", "nan", "1,2,3", " -nan ", "1__0", "\xa012,5　", "inf", "1e3", "R$ 1.234,50"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    staged = T.with_parsed(df, {"z": ("zero", "v"), "n": ("null", "v"), "q": ("quote", "v")})
    cols = staged.select("i", "z", "n", "q",
                         T.parse_or_zero(F.col("v")).alias("z2"), T.parse_or_null(F.col("v")).alias("n2"),
                         T.parse_quote(F.col("v")).alias("q2")).orderBy("i").collect()

    def same(a, b):
        return (a is None and b is None) or (a is not None and b is not None and
                                             ((math.isnan(a) and math.isnan(b)) or a == b))
    for r in cols:
        assert same(r.z, r.z2) and same(r.n, r.n2) and same(r.q, r.q2), r
