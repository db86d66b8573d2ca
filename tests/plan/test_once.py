"""What every position costs is computed once."""

import datetime

from pyspark.sql import functions as F

from quotaflow.functions import text as T
from quotaflow.operators import agenda as A
from quotaflow.operators import positions as P
from quotaflow.sources import fixtures as FX


def lines(df, node):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.replace("\n ", " ").splitlines() if node in x]


def test_filters_repeat_no_parse(spark):
    sheet = spark.range(5).select(F.col("id").alias("portfolio_id"), F.col("id").alias("row_idx"),
                                  *[F.concat(F.col("id").cast("string"), F.lit(",5")).alias(f"_c{i}") for i in range(25)])
    fund = P.fund_positions(sheet)
    assert lines(fund, "Filter") and not any("try_cast" in x or "trim" in x for x in lines(fund, "Filter"))
    pos = fund.select("*", F.lit(1.0).alias("monthly_income"))
    agenda = A.build(pos, datetime.date(2024, 6, 15))
    assert not any("regexp_extract" in x for x in lines(agenda, "Filter"))


def test_rows_are_kept_by_values_computed_once(spark):
    cells = {0: " abcd11\t", 5: "R$ 1.234,50", 8: "2,5", 9: "", 11: None, 17: "8%", 20: "15/07/2024", 24: " Log "}
    rows = [{**cells}, {**cells, 0: "ABCD12"}, {**cells, 5: "0"}, {**cells, 5: "nan"}, {**cells, 0: None}, {**cells, 0: "WXYZ11B"}]
    schema = "portfolio_id long, row_idx long, " + ", ".join(f"_c{i} string" for i in range(25))
    sheet = spark.createDataFrame([(1, n, *[r.get(i, "") for i in range(25)]) for n, r in enumerate(rows)], schema)
    got = {r.row_idx: (r.ticker, r.quantity, r.avg_cost, r.link) for r in P.valued(
        sheet, spark.createDataFrame([], "portfolio_id long, row_idx long, a string, b string, c string, d string"),
        spark.createDataFrame([], "ticker string, quote double")).collect()}
    link = "https://investidor10.com.br/fiis/{}/"
    assert got == {0: ("ABCD11", 1234.5, 0.0, link.format("abcd11")), 5: ("WXYZ11B", 1234.5, 0.0, link.format("wxyz11b"))}


def test_links_are_not_sorted_and_sent(spark):
    sheet = spark.createDataFrame([], "portfolio_id long, row_idx long, " + ", ".join(f"_c{i} string" for i in range(25)))
    manual = spark.createDataFrame([], "portfolio_id long, row_idx long, a string, b string, c string, d string")
    valued = P.valued(sheet, manual, spark.createDataFrame([], "ticker string, quote double"))
    assert valued.columns[:len(P.POSITION_COLUMNS)] == P.POSITION_COLUMNS
    plan = valued._jdf.queryExecution().analyzed().toString()
    assert plan.index("AS link") < plan.index("Window [")


def test_sheet_texts_are_made_once_a_ticker(spark, sf_small):
    for build in (FX.fund_sheet, FX.manual_sheet):
        plan = build(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert "format_number" in plan and "format_number" not in plan[:plan.index("Join Inner")]


def test_holdings_are_dealt_once(spark, sf_small):
    plan = FX.holdings(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    aggregates, rest = plan.split("Exchange", 1)
    assert aggregates.count("HashAggregate") and "REPARTITION_BY_NUM" in rest.splitlines()[0]


def test_numbers_lose_the_same_characters(spark):
    texts = ["R$ 1.234,56", "R $ 1", "RR$$ 2", "1,2,3", "8%", " 7 ", "", None, "%.,", "12.5", "R$-3,1%", " 5,0"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    bare = F.replace("c", F.lit("R$"), F.lit(""))
    for kind, old in {"zero": ",% .", "null": ",%.", "quote": ",."}.items():
        assert all(r.a == r.b for r in df.select(T._PRE[kind](F.col("c")).alias("a"), F.translate(bare, old, ".").alias("b")).collect())
    keys = df.select(T.clean_key(F.col("c")).alias("a"), F.upper(T.strip_py(F.col("c"))).alias("b")).collect()
    assert all(r.a == r.b for r in keys)
