"""Source and rate quirks: S3 locator, S4 last-N then numeric, S5 typed
values, A6 fallback, A7 chain."""

import json

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import kpis as K2
from quotaflow.sources import sheets as SH


def test_locate(spark):
    urls = ["https://docs.google.com/spreadsheets/d/ABC123/edit#gid=42",
            "https://docs.google.com/spreadsheets/d/e/PUB9/pubhtml?gid=7",
            "https://docs.google.com/spreadsheets/d/e/PUB9",
            "https://example.com/sheet.csv", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [(r.d, r.t) for r in df.orderBy("i").select(SH.locate(F.col("u")).alias("x"))
           .select(F.col("x.doc_id").alias("d"), F.col("x.tab_id").alias("t")).collect()]
    assert got == [("ABC123", 42), ("PUB9", 7), ("PUB9", None), ("https://example.com/sheet.csv", None),
                   (None, None), (None, None)]


def payload(entries):
    return json.dumps([{"data": d, "valor": v} for d, v in entries])


def test_rate_series_last_n_then_numeric(spark):
    p = payload([("01/01/2024", "0.04"), ("02/01/2024", "n/d"), ("03/01/2024", "0.05"), ("04/01/2024", "1_0")])
    df = spark.createDataFrame([("CDI", p)], "series_id string, payload string")
    got = [(str(r.rate_date), r.valor) for r in SH.rate_series(df, last_n=3).orderBy("rate_date").collect()]
    # the last 3 entries are 02/01 (not a number, dropped), 03/01 and 04/01
    assert got == [("2024-01-03", 0.05), ("2024-01-04", 10.0)]


def test_a_bad_date_fails_its_series_only(spark):
    rows = [("CDI", payload([("01/01/2024", "0.04"), ("2024?", "0.05")])), ("CDI", payload([("03/01/2024", "0.06")])),
            ("IPCA", payload([("01/02/2024", "0.3"), (None, "0.4")]))]
    df = spark.createDataFrame(rows, "series_id string, payload string")
    assert [(r.series_id, str(r.rate_date), r.valor) for r in SH.rate_series(df).collect()] == [("IPCA", "2024-02-01", 0.3)]
    assert SH.last_entries(df, 2).count() == 4


def test_named_rate_needs_a_number(spark):
    items = '[{"nome": "SELIC meta", "valor": "10.5"}, {"nome": "Taxa Selic", "valor": 10.25}, {"nome": "SELIC", "valor": 11}]'
    df = spark.createDataFrame([(items,)], "payload string")
    assert SH.named_rate(SH.named_rates(df)).first().rate == pytest.approx(0.1025)
    none = spark.createDataFrame([('[{"nome": "CDI", "valor": 10}]',)], "payload string")
    assert SH.named_rate(SH.named_rates(none)).first().rate is None


def test_compounded_rate_fallback(spark):
    good = spark.createDataFrame([("IPCA", payload([(f"{d:02d}/01/2024", "1.0") for d in range(1, 13)]))],
                                 "series_id string, payload string")
    v = K2.compounded_rate(SH.last_entries(good, 12)).first().inflation
    assert v == pytest.approx(1.01 ** 12 - 1)
    bad = spark.createDataFrame([("IPCA", payload([("01/01/2024", "1.0"), ("02/01/2024", "x")]))],
                                "series_id string, payload string")
    assert K2.compounded_rate(SH.last_entries(bad, 12)).first().inflation == pytest.approx(0.045)
    empty = spark.createDataFrame([("IPCA", "[]")], "series_id string, payload string")
    assert K2.compounded_rate(SH.last_entries(empty, 12)).first().inflation == pytest.approx(0.045)


def test_reference_rate_chain(spark):
    named_none = spark.createDataFrame([(None,)], "rate double")
    series = spark.createDataFrame([("SELIC", payload([("01/01/2024", "10.0"), ("02/01/2024", "10.5")]))],
                                   "series_id string, payload string")
    r = K2.reference_rate(named_none, SH.last_entries(series, 1)).first()
    assert r.official_rate == pytest.approx(0.105) and r.used_rate == pytest.approx(0.105)
    bad = spark.createDataFrame([("SELIC", payload([("01/01/2024", "n/d")]))], "series_id string, payload string")
    r = K2.reference_rate(named_none, SH.last_entries(bad, 1), override=0.13).first()
    assert r.official_rate == pytest.approx(0.12) and r.used_rate == pytest.approx(0.13)
