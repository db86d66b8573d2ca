"""K0 as a relation, A7 into K2, N18 on the two sections."""

import pytest
from pyspark.sql import functions as F

from quotaflow import params as PR
from quotaflow.operators import kpis as K2
from quotaflow.operators import screens as K
from quotaflow.params import ScreenParams

POS = ("portfolio_id long, ticker string, asset_type string, sector string, segment string, price double, avg_cost double, "
       "price_to_book double, dy_12m double, weight double, market_value double, source_rank int, row_idx long, link string")


def positions(spark):
    rows = []
    for p in (1, 2, 3, None):
        rows += [(p, f"A{i}", "FII", "Logística", "Tijolo", 10.0, 9.0, 0.85 + i / 20, 0.08 + i / 100, 0.1 * i / 6, 1000.0 * i, 0, i, "l")
                 for i in range(1, 6)]
    return spark.createDataFrame(rows, POS)


def params_of(df):
    return {r.portfolio_id: (r.k0_selic, r.k0_pvp_min, r.k0_pvp_max, r.k0_dy_min, r.k0_brick_pct)
            for r in df.select("portfolio_id", *[c for c in df.columns if c.startswith("k0_")]).distinct().collect()}


def test_layers(spark):
    over = spark.createDataFrame([(1, 0.95, 0.5, None, 0.15), (2, None, None, 0.01, 0.0)],
                                 "portfolio_id long, pvp_min double, pvp_max double, dy_min double, selic double")
    got = params_of(PR.with_params(positions(spark), over, ScreenParams(), F.lit(0.11)))
    assert got == {1: (0.15, 0.95, 0.95, 0.12, 0.6), 2: (0.11, 0.8, 0.99, 0.01, 0.6), 3: (0.11, 0.8, 0.99, 0.12, 0.6),
                   None: (0.11, 0.8, 0.99, 0.12, 0.6)}
    nothing = spark.createDataFrame([], "portfolio_id long")
    assert set(params_of(PR.with_params(positions(spark), nothing, ScreenParams(), F.lit(0.11))).values()) == {(0.11, 0.8, 0.99, 0.12, 0.6)}


def test_constant_and_joined_parameters_agree(spark):
    pos, params = positions(spark), ScreenParams(dy_min=0.09, pvp_max=1.05, contribution_min=0.0)
    nothing = spark.createDataFrame([], "portfolio_id long")
    joined = PR.with_params(pos, nothing, params, F.lit(0.13))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(K.opportunities(joined, None), K.opportunities(pos, params))
    flat = ScreenParams(selic=0.0, dy_min=0.09, pvp_max=1.05, contribution_min=0.0)
    cols = ["portfolio_id", "ticker", "risk_reasons", "risk_rank", "risk_label"]
    assert same(K.classify_risk(joined, None).select(*cols), K.classify_risk(pos, flat, 0.13).select(*cols))
    assert same(K.risk_radar(K.classify_risk(joined, None)), K.risk_radar(K.classify_risk(pos, flat, 0.13)))


@pytest.mark.parametrize("named, series, want", [(0.1, 9.0, 0.1), (None, 9.0, 0.09), (None, None, 0.12)])
def test_rate_chain_reaches_the_radar(spark, named, series, want):
    rate = K2.reference_rate(spark.createDataFrame([(named,)], "rate double"),
                             spark.createDataFrame([("2024-01-01", series)], "rate_date string, valor double"))
    over = spark.createDataFrame([(1, 0.2)], "portfolio_id long, selic double")
    df = PR.with_params(positions(spark), over, ScreenParams(), rate.select("official_rate").scalar())
    got = {r.portfolio_id: r.k0_selic for r in K.classify_risk(df, None).collect()}
    assert got == {1: 0.2, 2: pytest.approx(want), 3: pytest.approx(want), None: pytest.approx(want)}


def test_private_sections_are_empty(spark):
    pos, params = positions(spark), ScreenParams(dy_min=0.05, contribution_min=0.0)
    risk = K.classify_risk(pos, params, 0.12)
    assert K.opportunities(pos, params).count() > 0 and K.risk_radar(risk).count() > 0
    assert K.opportunities(pos, params, privacy=True).count() == 0 and K.risk_radar(risk, privacy=True).count() == 0
    hidden = F.col("portfolio_id") == 1
    assert 1 not in {r.portfolio_id for r in K.risk_radar(risk, privacy=hidden).collect()}
