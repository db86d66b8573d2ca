"""R2: numbers as Python prints them."""

import csv
import io
import math
import random
import struct

from pyspark.sql import functions as F

from quotaflow.functions import text as T
from quotaflow.operators import report as R


def texts(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    return [r.t for r in df.select("i", T.py_number(F.col("x")).alias("t")).orderBy("i").collect()]


def test_numbers_equal_repr(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, 12345678.0, 0.0005, 1e16, 1e-5, 9999999999999998.0, 1e15, 123456789012345680.0, 2e-3, 2.0**-44,
              1e22, 1e23, 2e23, 5e-324, 1.7976931348623157e308, 0.1 + 0.2, 1 / 3, 100.0, 1e-4, 9.999e-5, 4.35, 2.2250738585072014e-308]
    values += [math.ldexp(1.0, e) for e in range(-300, 300, 7)]
    values += [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-20, 25) for _ in range(2000)]
    values += [round(r.random() * 10 ** r.randint(0, 9), r.randint(0, 6)) for _ in range(1000)]
    values += [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(1000)]
    values += [math.nan, math.inf, -math.inf]
    for v, t in zip(values, texts(spark, values)):
        assert t == repr(v), v
    assert texts(spark, [None]) == [None]


def test_context_lines_equal_a_csv_writer(spark):
    rows = [(1, "A,B", "FII", 12345678.0, 0.0005, 1e-5, 30.0), (1, 'C"D', "Ação", 1e16, float("nan"), None, 20.0), (1, "E", "FII", 0.5, 1.0, 0.08, 10.0)]
    pos = spark.createDataFrame(rows, "portfolio_id long, ticker string, asset_type string, price double, price_to_book double, dy_12m double, market_value double")
    totals = spark.createDataFrame([(1, 60.0, 50.0)], "portfolio_id long, total_value double, total_invested double")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["Ativo", "Tipo", "Preço Atual", "P/VP", "DY (12m)"])
    for _, *cells, _ in rows:
        w.writerow(["" if c is None or c != c else c for c in cells])
    got = R.context(pos, totals).first().context
    assert got.startswith(out.getvalue())
