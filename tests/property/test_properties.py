
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import exposure as X
from quotaflow.operators import kpis as K2
from quotaflow.operators import positions as P
from quotaflow.operators import series as S
from quotaflow.plans import catalog as C
from quotaflow.sources import fixtures as FX
from quotaflow.sources import sheets as SH
from quotaflow.session import scratch_path


def test_weights_sum_to_one(spark, sf_small):
    pos = C.positions(spark, sf_small)
    sums = pos.groupBy("portfolio_id").agg(F.sum("weight").alias("w"), F.sum("market_value").alias("v"))
    bad = sums.where((F.col("v") > 0) & (F.abs(F.col("w") - 1) > 1e-9)).count()
    assert bad == 0


def test_dense_equals_delta_sum(spark, sf_small):
    qty = K2.qty_by_ticker(FX.large_holdings(spark, sf_small))
    panel = S.clean_panel(FX.large_panel(spark, sf_small), dt.date(2001, 11, 4), 24)
    a = S.portfolio_series(qty, panel, []).withColumnRenamed("value", "a")
    b = S.portfolio_series_dense(qty, panel, []).withColumnRenamed("value", "b")
    j = a.join(b, ["portfolio_id", "date"], "full")
    assert j.where(F.col("a").isNull() | F.col("b").isNull()).count() == 0
    assert j.where(F.abs(F.col("a") - F.col("b")) > 1e-6 * F.abs(F.col("b")) + 1e-6).count() == 0


def test_rollup_grand_total_is_portfolio_total(spark, sf_small):
    pos = C.positions(spark, sf_small)
    top = X.hierarchy(pos).where(F.col("level") == 0).select("portfolio_id", "node_value")
    tot = pos.groupBy("portfolio_id").agg(F.sum("market_value").alias("t"))
    assert top.join(tot, "portfolio_id").where(F.abs(F.col("node_value") - F.col("t")) > 1e-6).count() == 0


def test_top_k_is_subset_of_unfiltered(spark, sf_small):
    q = C.REGISTRY["opportunities"](spark, sf_small)
    assert q.groupBy("portfolio_id").count().where(F.col("count") > 4).count() == 0


def test_single_portfolio_equals_many(spark, sf_small):
    """A portfolio's screen result does not depend on the other portfolios."""
    pos = C.positions(spark, sf_small)
    pid = pos.select(F.min("portfolio_id")).first()[0]
    from quotaflow.operators import screens as K
    from quotaflow.params import DEFAULT_RUN
    alone = K.opportunities(pos.where(F.col("portfolio_id") == pid), DEFAULT_RUN.screens).drop("portfolio_id")
    many = K.opportunities(pos, DEFAULT_RUN.screens).where(F.col("portfolio_id") == pid).drop("portfolio_id")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, many.collect()))


def test_sheet_csv_round_trip(spark, sf_small):
    """Sheets written as CSV text and read back give the same positions."""
    import uuid
    base = scratch_path(spark, f"sheets-{uuid.uuid4().hex}")
    fund = FX.fund_sheet(spark, sf_small)
    cells = [f"_c{i}" for i in range(25)]
    fund.select(*cells).write.option("header", False).csv(f"{base}/fund")
    manual = FX.manual_sheet(spark, sf_small)
    manual.select("Ativo", "Tipo", "Qtd", "Valor").write.option("header", True).csv(f"{base}/manual")
    f_back = SH.read_sheet(spark, f"{base}/fund", header=False)
    m_back = SH.read_sheet(spark, f"{base}/manual", header=True)
    assert len(f_back.columns) == 25 and SH.headed_first_four(m_back) is not None
    key = ["ticker", "quantity", "price", "avg_cost", "book_value", "dy_12m", "ex_date_text", "sector"]
    a = P.fund_positions(f_back.withColumn("portfolio_id", F.lit(0)).withColumn("row_idx", F.lit(0))).select(*key)
    b = P.fund_positions(fund).select(*key)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    m1 = P.manual_positions(m_back.withColumn("portfolio_id", F.lit(0)).withColumn("row_idx", F.lit(0)))
    m2 = P.manual_positions(manual)
    cols = ["ticker", "asset_type", "quantity", "price"]
    assert m1.select(*cols).exceptAll(m2.select(*cols)).count() == 0


def test_headed_sheet_needs_four_columns(spark):
    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string")
    assert SH.headed_first_four(df) is None


def test_snapshot_without_totals_fails(spark, sf_small):
    import uuid
    path = scratch_path(spark, f"snap-{uuid.uuid4().hex}")
    pos = C.positions(spark, sf_small)
    k = pos.groupBy("portfolio_id").agg(F.sum("market_value").alias("total_value"),
                                        F.sum("invested").alias("total_invested"))
    SH.write_snapshot(pos, k.where(F.col("portfolio_id") % 2 == 0), path, dt.datetime(2024, 6, 15, 8, 0))
    _, p = SH.read_latest_snapshot(spark, path)
    with pytest.raises(Exception):
        p.collect()


def test_screens_same_with_or_without_carried_stats(spark, sf_small):
    """Screens read the per-portfolio figures left on the rows by the
    weights step; recomputing them by aggregate + join gives the same rows."""
    from quotaflow.operators import screens as K
    from quotaflow.params import DEFAULT_RUN
    pos = C.positions(spark, sf_small)
    bare = pos.drop(*P.PORTFOLIO_STATS)
    for fn in (lambda d: K.opportunities(d, DEFAULT_RUN.screens), K.value_matrix,
               lambda d: K.risk_radar(K.classify_risk(d, DEFAULT_RUN.screens, 0.12))):
        a, b = fn(pos), fn(bare)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
