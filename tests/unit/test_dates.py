"""Hand-written cases of FIXTURES.md section 3 for the date rules."""

import datetime as dt

from pyspark.sql import functions as F

from quotaflow.functions import dates as D

REF = dt.date(2024, 6, 15)


def resolve(spark, values, ref=REF):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    a = [r[0] for r in df.orderBy("i").select(D.resolve_ex_date(F.col("v"), ref)).collect()]
    b = [r[0] for r in D.with_ex_date(df, "v", ref, "x").orderBy("i").select("x").collect()]
    assert a == b
    return a


def test_resolve_grammars(spark):
    got = resolve(spark, ["05/01/24", "5/1/99", "5/1/68", "14/06", "15/06", "29/02", "31/02/2024", "-", "abc",
                          "0º DIA ÚTIL", None, ""])
    assert got == [dt.date(2024, 1, 5), dt.date(1999, 1, 5), dt.date(2068, 1, 5), dt.date(2025, 6, 14),
                   dt.date(2024, 6, 15), None, None, None, None, None, None, None]


def nth(spark, month, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n int")
    return [r[0] for r in df.select(D.nth_business_day(F.lit(month).cast("date"), F.col("n"))).collect()]


def test_nth_business_day(spark):
    assert nth(spark, "2024-06-01", [1, 2, 5]) == [dt.date(2024, 6, 3), dt.date(2024, 6, 3), dt.date(2024, 6, 6)]
    assert nth(spark, "2024-03-01", [1, 2, 5]) == [dt.date(2024, 3, 1), dt.date(2024, 3, 4), dt.date(2024, 3, 7)]
    assert nth(spark, "2025-02-01", [1, 2, 5]) == [dt.date(2025, 2, 3), dt.date(2025, 2, 3), dt.date(2025, 2, 6)]
    assert nth(spark, "2024-06-01", [0]) == [None]


def test_nth_business_day_matches_calendar_count(spark):
    """Closed form vs counting weekdays on a generated calendar (brute force)."""
    import pandas as pd
    rows = []
    for y in (2023, 2024, 2025):
        for m in range(1, 13):
            m0 = dt.date(y, m, 1)
            for n in range(1, 30):
                want = (pd.Timestamp(m0) + pd.offsets.BDay(n - 1)).date()
                rows.append((m0, n, want))
    df = spark.createDataFrame(rows, "m0 date, n int, want date")
    bad = df.where(D.nth_business_day(F.col("m0"), F.col("n")) != F.col("want")).count()
    assert bad == 0


def test_last_business_day(spark):
    df = spark.createDataFrame([("2024-06-01",)], "m string")
    assert df.select(D.last_business_day(F.col("m").cast("date"))).first()[0] == dt.date(2024, 6, 28)
