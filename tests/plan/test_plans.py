"""Physical-plan checks: top-k uses a partial group limit, look-back and
filters reach the Parquet scan, Python runs only in the page extractor."""

import __spark_entry__ as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_window_group_limit(spark, sf_small):
    p = plan_of(E.queries()["opportunities"](spark, sf_small))
    assert "WindowGroupLimit" in p


def test_filters_reach_scan(spark, sf_small):
    p = plan_of(E.queries()["price_panel"](spark, sf_small))
    # the look-back is a date predicate pushed into the panel scan
    assert "GreaterThanOrEqual(date,2023-12-15)" in p and "LessThanOrEqual(date,2024-06-15)" in p
    # only the three panel columns are read
    assert "ReadSchema: struct<date:date,symbol:string,close:double>" in p


def test_python_only_in_extractor(spark, sf_small):
    qs = E.queries()
    for name in ["opportunities", "risk_radar", "hierarchy_rollup", "portfolio_series", "dividend_calendar"]:
        p = plan_of(qs[name](spark, sf_small))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p, name
    assert "MapInPandas" in plan_of(qs["indicators"](spark, sf_small))


def test_facts_are_not_the_broadcast_side(spark, sf_small):
    """Fact rows joined to their per-portfolio aggregate use a left join, so
    only the aggregate can be the build side of a broadcast hash join."""
    qs = E.queries()
    for name in ["weights", "opportunities", "dividend_calendar", "agenda_metrics"]:
        df = qs[name](spark, sf_small)
        df.collect()  # final adaptive plan
        final = plan_of(df).split("Initial Plan")[0]
        assert "BuildLeft" not in final, name


def final_plan(df):
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


def test_no_nested_loops_in_series_and_kpis(spark, sf_small):
    qs = E.queries()
    for name in ["relative_performance", "rebased_series", "evolution_wide", "gap_fill", "portfolio_series", "benchmark_align",
                 "rate_asof", "portfolio_kpis", "real_income", "risk_by_params"]:
        p = final_plan(qs[name](spark, sf_small))
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_gap_fill_has_no_window_by_holding(spark, sf_small):
    p = plan_of(E.queries()["gap_fill"](spark, sf_small))
    windows = [line for line in p.splitlines() if "Window [" in line]
    assert windows and not any("ticker" in line or "portfolio_id" in line for line in windows)


def test_panel_is_read_once_and_by_month(spark, sf_small):
    p = plan_of(E.queries()["price_panel"](spark, sf_small))
    assert p.count("close:double>") == 1
    assert "PartitionFilters: [isnotnull(month" in p and "2023-12-01" in p


def test_lookup_parses_the_pages_once(spark, sf_small):
    qs = E.queries()
    for name in ["indicator_lookup", "indicator_not_found"]:
        assert plan_of(qs[name](spark, sf_small)).split("Initial Plan")[0].count("MapInPandas") == 1, name


def test_listings_are_not_sorted_as_a_whole(spark, sf_small):
    qs = E.queries()
    for name in ["sector_exposure", "best_discounts", "agenda_month", "agenda_by_date", "agenda_by_ticker"]:
        assert "rangepartitioning" not in plan_of(qs[name](spark, sf_small)), name


def test_evolution_computes_the_portfolio_series_once(spark, sf_small):
    p = final_plan(E.queries()["evolution_wide"](spark, sf_small))
    assert p.count("sum(_w") <= 2 or p.count("Window [sum(") <= 2
