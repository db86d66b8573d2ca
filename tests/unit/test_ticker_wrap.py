"""Parts whose tickers are one: 26**4 keys apart."""

import uuid

from quotaflow.session import scratch_path
from quotaflow.sources import fixtures as FX


def test_parts_that_share_a_ticker_are_one_holding(spark):
    sf = scratch_path(spark, f"wrap-{uuid.uuid4().hex}")
    a, b = 5, 5 + 26 ** 4
    tables = {
        "lineitem": ([(1, a, 2.0, 20.0, 0.05, 0.01), (1, b, 3.0, 60.0, 0.05, 0.03)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "orders": ([(1, 7)], "o_orderkey long, o_custkey long"),
        "part": ([(a, "STANDARD X", 10.0), (b, "SMALL Y", 99.0)], "p_partkey long, p_type string, p_retailprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    one = FX.raw_holdings(spark, sf).collect()
    assert [(r.k, r.qty, r.mkt_price, r.ticker, r.sector_text, r.avg_cost) for r in one] == [(5, 5.0, 16.0, "AAAF11", "Logística", 20.0)]
    assert FX.fund_sheet(spark, sf).count() == 1
    assert FX.quotes(spark, sf).count() == 0
