"""portfolio_series_blocks: equal to portfolio_series, and what it exchanges."""

import datetime as dt
import random

import pytest

from quotaflow.operators import series as S
from quotaflow.plans import catalog


def inputs(spark):
    rng = random.Random(11)
    day = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=i)
    tickers = [f"T{i:03d}11" for i in range(40)]
    panel = [(day(d), f"{t}.SA", None if rng.random() < 0.2 else round(rng.uniform(1, 90), 2))
             for t in tickers[:30] for d in rng.sample(range(60), rng.randrange(1, 25))]
    panel += [(day(d), "NONE11.SA", None) for d in (3, 50)] + [(day(55), "LATE11.SA", 7.5), (day(4), None, 3.0)]
    qty = [(p, t, float(rng.randrange(1, 50))) for p in range(25) for t in rng.sample(tickers, rng.randrange(1, 30))]
    qty += [(None, tickers[0], 5.0), (None, "LATE11", 2.0), (77, "NONE11", 1.0), (78, "GONE11", 1.0), (79, tickers[1], None),
            (80, "LATE11", 4.0), (80, "LATE11.SA", 1.0), (81, None, 3.0), (82, tickers[2], float("nan")), (82, "LATE11", 1.0)]
    return (spark.createDataFrame(qty, "portfolio_id long, ticker string, quantity double"),
            spark.createDataFrame(panel, "date date, symbol string, close double"))


def sorted_rows(df):
    return sorted(((r.portfolio_id is None, r.portfolio_id or 0, r.date, str(round(r.value, 6) + 0.0)) for r in df.collect()))


@pytest.mark.parametrize("closes, cells, terms", [(S.BLOCK_CLOSES, S.GRID_CELLS, S.GRID_TERMS), (60, 1, 3), (7, 150, 1)])
def test_blocks_equal_the_series(spark, monkeypatch, closes, cells, terms):
    monkeypatch.setattr(S, "BLOCK_CLOSES", closes)
    monkeypatch.setattr(S, "GRID_CELLS", cells)
    monkeypatch.setattr(S, "GRID_TERMS", terms)
    qty, panel = inputs(spark)
    assert sorted_rows(S.portfolio_series_blocks(qty, panel)) == sorted_rows(S.portfolio_series(qty, panel, []))


def test_no_prices_and_no_holdings(spark):
    qty, panel = inputs(spark)
    assert S.portfolio_series_blocks(qty, panel.limit(0)).count() == 0
    assert S.portfolio_series_blocks(qty.limit(0), panel).count() == 0
    assert S.portfolio_series_blocks(qty, panel.limit(0)).dtypes == S.portfolio_series(qty, panel, []).dtypes


def test_holdings_by_days_are_not_exchanged(spark, sf_small):
    plan = catalog.REGISTRY["portfolio_series_large"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(portfolio_id" not in plan and "Window" not in plan
