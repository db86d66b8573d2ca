"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the given tables (through the fixture views) and runs the
library operator on the whole data. Doubles are rounded on output (money 4
places, ratios 6) so the differential check does not depend on summation
order.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.operators import agenda as A
from quotaflow.functions import dates as D
from quotaflow.operators import exposure as X
from quotaflow.operators import report as R
from quotaflow.session import scratch_path, stage
from quotaflow.sources import sheets as SH
from quotaflow.streaming import refresh as RS
from quotaflow.operators import indicators as H
from quotaflow.operators import kpis as K2
from quotaflow.operators import series as S
from quotaflow.functions import text as T
from quotaflow.operators import positions as P
from quotaflow.operators import screens as K
from quotaflow import params as PR
from quotaflow.params import DEFAULT_RUN
from quotaflow.sources import fixtures as FX
from quotaflow.sources import sheet_files as SF
from quotaflow.sources import sheet_fixtures as SX

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

MONEY = {"quantity", "avg_cost", "price", "book_value", "market_value", "invested", "profit", "monthly_income",
         "suggested_contribution", "total_value", "sector_value", "node_value", "est_dividend"}


# Amounts derived from a mean of shares (total x mean weight) sit on exact
# ties at 4 places, where summation order decides; they are shown in cents.
CENTS = {"suggested_contribution", "value"}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, money: set[str] | None = None) -> DataFrame:
    """Round double columns: money-like to 4 places, everything else to 6.

    Rounds the scaled binary value (``round(x * 10^p) / 10^p``), as DuckDB's
    ``round(double, p)`` does, so ties such as 69.99465 agree on both sides."""
    money = MONEY | (money or set())
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            scale = 10.0 ** (2 if f.name in CENTS else 4 if f.name in money else 6)
            out.append((F.round(F.col(f.name) * scale) / scale).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- positions
# Inputs the reference receives from outside (sheets, quotes, market data,
# rate services, fetched pages), derived from the test tables and stored once
# per application; queries scan them as stored data.
STORED_INPUTS = ["fund_sheet", "manual_sheet", "quotes", "small_panel", "small_holdings", "large_panel",
                 "large_holdings", "rate_payloads", "named_rate_payload", "indicator_pages", "refresh_pages"]


def stored_input(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return FX.stored(spark, sf, name, getattr(FX, name))


def fund_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return FX.stored(spark, sf, "fund_sheet", FX.fund_sheet)


def manual_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return FX.stored(spark, sf, "manual_sheet", FX.manual_sheet)


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    return FX.stored(spark, sf, "quotes", FX.quotes)


def positions(spark: SparkSession, sf: str, *columns: str, staged: bool = True) -> DataFrame:
    """P1-P8. Readers of the weights, or several readers, name the columns that
    they use, which are staged; a single reader without weights stages nothing."""
    return P.build(fund_sheet(spark, sf), manual_sheet(spark, sf), quotes(spark, sf), staged, list(columns) or None)


# The columns of the positions that the screens read.
OPPORTUNITY_COLS = ("source_rank", "row_idx", "ticker", "price", "link")
RISK_COLS = ("ticker",)
RADAR_COLS = ("source_rank", "row_idx", "ticker", "price", "avg_cost", "link")
INVENTORY_COLS = ("link", "ticker", "avg_cost", "price", "quantity", "return_pct", "monthly_income")


POS_COLS = list(P.POSITION_COLUMNS)


@register("fund_positions")
def q_fund_positions(spark, sf):
    return rounded(P.fund_positions(fund_sheet(spark, sf)).select(*POS_COLS))


@register("manual_positions")
def q_manual_positions(spark, sf):
    return rounded(P.manual_positions(manual_sheet(spark, sf)).select(*POS_COLS))


@register("quote_enrich")
def q_quote_enrich(spark, sf):
    m = P.enrich_quotes(P.manual_positions(manual_sheet(spark, sf)), quotes(spark, sf))
    return rounded(m.select("portfolio_id", "ticker", "asset_type", "price"))


@register("union_positions")
def q_union_positions(spark, sf):
    funds = P.fund_positions(fund_sheet(spark, sf))
    manual = P.enrich_quotes(P.manual_positions(manual_sheet(spark, sf)), quotes(spark, sf))
    return rounded(P.union_positions(funds, manual))


@register("dedup_first")
def q_dedup_first(spark, sf):
    funds = P.fund_positions(fund_sheet(spark, sf))
    manual = P.enrich_quotes(P.manual_positions(manual_sheet(spark, sf)), quotes(spark, sf))
    return rounded(P.dedup_keep_first(P.union_positions(funds, manual)))


@register("valuation")
def q_valuation(spark, sf):
    return rounded(positions(spark, sf, staged=False).select(
        "portfolio_id", "ticker", "asset_type", "market_value", "invested", "profit", "monthly_income",
        "price_to_book", "return_pct"))


@register("valuation_scrubbed")
def q_valuation_scrubbed(spark, sf):
    """P6 + N19 on positions with prices, costs and yields that are no numbers
    (row_idx % 7: 0 inf price, 1 NaN price, 2 -inf cost, 3 NaN yield)."""
    funds = P.fund_positions(fund_sheet(spark, sf))
    manual = P.enrich_quotes(P.manual_positions(manual_sheet(spark, sf)), quotes(spark, sf))
    n = F.col("row_idx") % 7
    broken = P.dedup_keep_first(P.union_positions(funds, manual)).withColumns({
        "price": F.when(n == 0, float("inf")).when(n == 1, float("nan")).otherwise(F.col("price")),
        "avg_cost": F.when(n == 2, float("-inf")).otherwise(F.col("avg_cost")),
        "dy_12m": F.when(n == 3, float("nan")).otherwise(F.col("dy_12m"))})
    return rounded(P.valuation(broken).select(
        "portfolio_id", "ticker", "asset_type", "price", "avg_cost", "dy_12m", "market_value", "invested", "profit",
        "monthly_income", "price_to_book", "return_pct"))


@register("valid_ticker_mixed")
def q_valid_ticker_mixed(spark, sf):
    """N7 over every part: tickers of the right and of wrong shapes (k % 8)."""
    k = F.col("p_partkey")
    t = FX.ticker_from_key(k)
    m = k % 8
    shaped = (F.when(m == 0, t).when(m == 1, F.concat(t, F.lit("B"))).when(m == 2, F.concat(F.substring(t, 1, 3), F.lit("11")))
              .when(m == 3, F.concat(F.substring(t, 1, 4), F.lit("12"))).when(m == 4, F.concat(t, F.lit("C")))
              .when(m == 5, F.concat(F.lit(" "), F.lower(t), F.lit("\t"))).when(m == 6, F.concat(F.lit("1"), F.substring(t, 2, 5)))
              .otherwise(F.lit("")))
    return FX.table(spark, sf, "part").select(k.alias("k"), T.is_valid_ticker(T.clean_key(shaped)).alias("valid"))


@register("weights")
def q_weights(spark, sf):
    return rounded(positions(spark, sf, "ticker").select("portfolio_id", "ticker", "asset_type", "market_value", "weight"))


@register("segment")
def q_segment(spark, sf):
    return positions(spark, sf, staged=False).select("portfolio_id", "ticker", "asset_type", "sector", "segment")


# ------------------------------------------------------------- sheet files
FUND_WIDTH = max(P.COL_TICKER, P.COL_QTY, P.COL_PRICE, P.COL_AVG_COST, P.COL_BOOK, P.COL_DY) + 1


def _sheet_files(spark, sf, kind):
    """(rows, ledger) of the fund or manual sheets as files; the expected
    sources are all customers' portfolios."""
    root = SX.sheet_root(spark, sf, kind, fund_sheet(spark, sf) if kind == "fund" else manual_sheet(spark, sf))
    rows = SF.read_sheets(spark, root)
    expected = FX.table(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio_id"))
    if kind == "fund":
        return rows, SF.source_ledger(spark, root, rows, FUND_WIDTH, expected)
    return rows, SF.source_ledger(spark, root, rows, SF.MANUAL_COLUMNS, expected, header=True)


def _fund_file_positions(spark, sf):
    rows, ledger = _sheet_files(spark, sf, "fund")
    return P.fund_positions(SF.positional(SF.usable(rows, ledger), P.COL_SECTOR + 1))


def _manual_file_positions(spark, sf):
    rows, ledger = _sheet_files(spark, sf, "manual")
    return P.manual_positions(SF.headed(SF.usable(rows, ledger)))


@register("sheet_positional")
def q_sheet_positional(spark, sf):
    """S1 -> P1: fund positions of the sheet files, rows numbered as read."""
    return rounded(_fund_file_positions(spark, sf).select(*POS_COLS))


@register("sheet_headed")
def q_sheet_headed(spark, sf):
    """S2 -> P2: manual positions of the sheet files, rows numbered as read."""
    return rounded(_manual_file_positions(spark, sf).select(*POS_COLS))


@register("source_ledger")
def q_source_ledger(spark, sf):
    """What became of every expected source."""
    fund, manual = (_sheet_files(spark, sf, kind)[1].select(F.lit(kind).alias("kind"), "*") for kind in ("fund", "manual"))
    return fund.unionByName(manual)


@register("positions_from_sheets")
def q_positions_from_sheets(spark, sf):
    """P1-P7 over the sheet files: an unusable sheet costs its own rows only."""
    manual = P.enrich_quotes(_manual_file_positions(spark, sf), quotes(spark, sf))
    pos = P.union_positions(_fund_file_positions(spark, sf), manual).transform(P.dedup_keep_first).transform(
        P.valuation)
    pos = stage(pos, "positions").transform(P.with_weights)
    return rounded(pos.select("portfolio_id", "ticker", "asset_type", "sector", "ex_date_text", "market_value", "profit", "weight"))


# ------------------------------------------------------------------ screens
@register("opportunities")
def q_opportunities(spark, sf):
    return rounded(K.opportunities(positions(spark, sf, *OPPORTUNITY_COLS), DEFAULT_RUN.screens))


@register("risk_classify")
def q_risk_classify(spark, sf):
    c = K.classify_risk(positions(spark, sf, *RISK_COLS), DEFAULT_RUN.screens, DEFAULT_RUN.official_rate)
    return rounded(c.select("portfolio_id", "ticker", "price_to_book", "dy_12m", "risk_reasons",
                            "risk_rank", "risk_label"))


@register("risk_radar")
def q_risk_radar(spark, sf):
    c = K.classify_risk(positions(spark, sf, *RADAR_COLS), DEFAULT_RUN.screens, DEFAULT_RUN.official_rate)
    return rounded(K.risk_radar(c).select("portfolio_id", "rank", "ticker", "market_value", "risk_rank",
                                          "risk_label", "risk_reasons"))


def _param_overrides(spark, sf):
    """Stand-in for the users' parameters: one row for three customers in four.
    By c_custkey % 4: 0 a P/VP max below the min; 1 a lower yield and the account
    balance as least contribution; 2 a rate of their own (0 for every other one,
    which means the official rate) and other shares of it; 3 none."""
    c = FX.table(spark, sf, "customer")
    k = F.col("c_custkey")
    case = lambda m, v: F.when(k % 4 == m, v)
    return c.where(k % 4 != 3).select(
        k.alias("portfolio_id"), case(0, F.lit(0.95)).alias("pvp_min"), case(0, F.lit(0.5)).alias("pvp_max"),
        case(1, F.lit(0.085)).alias("dy_min"), case(1, F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("contribution_min"),
        case(2, F.when(k % 8 == 2, 0.0).otherwise(0.15)).alias("selic"), case(2, F.lit(0.5)).alias("brick_pct"),
        case(2, F.lit(0.9)).alias("paper_pct"))


def _positions_with_params(spark, sf, named: bool = True, series: str = "SELIC"):
    """Positions with each portfolio's parameters; the official rate is A7's
    chain over the rate sources (``named`` False: the named list failed)."""
    hit = SH.named_rate(SH.named_rates(stored_input(spark, sf, "named_rate_payload"))) if named else None
    rate = K2.reference_rate(hit, SH.last_entries(_payloads(spark, sf, series), 1))
    return PR.with_params(positions(spark, sf, *OPPORTUNITY_COLS), _param_overrides(spark, sf), DEFAULT_RUN.screens,
                          rate.select("official_rate").scalar())


@register("opportunities_by_params")
def q_opportunities_by_params(spark, sf):
    """K0 + K1: every portfolio by its own parameters."""
    return rounded(K.opportunities(_positions_with_params(spark, sf), None))


@register("risk_by_params")
def q_risk_by_params(spark, sf):
    """K0 + A7 + K2: every portfolio by its own parameters and rate."""
    c = K.classify_risk(_positions_with_params(spark, sf), None)
    return rounded(c.select("portfolio_id", "ticker", F.col("k0_selic").alias("used_rate"), "risk_reasons", "risk_rank", "risk_label"))


@register("risk_by_series_rate")
def q_risk_by_series_rate(spark, sf):
    """A7's second source into K2: the named list is not there."""
    c = K.classify_risk(_positions_with_params(spark, sf, named=False), None)
    return rounded(c.select("portfolio_id", "ticker", F.col("k0_selic").alias("used_rate"), "risk_rank"))


@register("risk_by_default_rate")
def q_risk_by_default_rate(spark, sf):
    """A7's default into K2: no named list, and no such series."""
    c = K.classify_risk(_positions_with_params(spark, sf, named=False, series="none"), None)
    return rounded(c.select("portfolio_id", "ticker", F.col("k0_selic").alias("used_rate"), "risk_rank"))


@register("private_sections")
def q_private_sections(spark, sf):
    """K1 and K3 where odd portfolios are in privacy mode."""
    hidden = F.col("portfolio_id") % 2 == 1
    pos = positions(spark, sf, *RADAR_COLS)
    cols = ["portfolio_id", "rank", "ticker"]
    opp = K.opportunities(pos, DEFAULT_RUN.screens, privacy=hidden).select(F.lit("opportunities").alias("section"), *cols)
    radar = K.risk_radar(K.classify_risk(pos, DEFAULT_RUN.screens, DEFAULT_RUN.official_rate), privacy=hidden)
    return opp.unionByName(radar.select(F.lit("radar").alias("section"), *cols))


@register("value_matrix")
def q_value_matrix(spark, sf):
    return rounded(K.value_matrix(positions(spark, sf, "ticker")))


@register("best_discounts")
def q_best_discounts(spark, sf):
    return rounded(K.best_discounts(positions(spark, sf, "ticker", "price")))


@register("inventory")
def q_inventory(spark, sf):
    return rounded(K.inventory(positions(spark, sf, *INVENTORY_COLS)))


@register("top15")
def q_top15(spark, sf):
    return rounded(K.top_by_value(positions(spark, sf, staged=False)))


# ----------------------------------------------------------------- exposure
@register("sector_exposure")
def q_sector_exposure(spark, sf):
    return rounded(X.by_sector(positions(spark, sf, staged=False)))


@register("hierarchy_rollup")
def q_hierarchy_rollup(spark, sf):
    return rounded(X.hierarchy(positions(spark, sf, staged=False)))


# ------------------------------------------------------------------- agenda
def _agenda(spark, sf):
    """The agenda feeds the month choice and the slices; it is staged once, so
    the position build, which it alone reads, is not."""
    return stage(A.build(positions(spark, sf, staged=False), DEFAULT_RUN.reference_date), "agenda")


@register("agenda")
def q_agenda(spark, sf):
    ag = A.build(positions(spark, sf, staged=False), DEFAULT_RUN.reference_date)
    return rounded(ag.select("portfolio_id", "ticker", "ex_date_text", "ex_date", "status", "month", "est_dividend",
                             "detail_link"))


@register("agenda_default_month")
def q_agenda_default_month(spark, sf):
    m = A.months(A.build(positions(spark, sf, staged=False), DEFAULT_RUN.reference_date), DEFAULT_RUN.reference_date)
    return m.select("portfolio_id", "chosen_month", F.size("months").alias("n_months"),
                    F.array_join(F.transform("months", lambda d: d.cast("string")), ",").alias("months"))


@register("agenda_month")
def q_agenda_month(spark, sf):
    ag = _agenda(spark, sf)
    return rounded(A.month_slice(ag, A.chosen_months(ag, DEFAULT_RUN.reference_date)))


@register("agenda_metrics")
def q_agenda_metrics(spark, sf):
    ag = _agenda(spark, sf)
    ref = DEFAULT_RUN.reference_date
    return rounded(A.metrics(ag, A.chosen_months(ag, ref), ref), {"month_total", "passed", "pending"})


@register("agenda_metrics_past_month")
def q_agenda_metrics_past_month(spark, sf):
    """C4 for a month other than the reference's: nothing counts as passed."""
    ag = _agenda(spark, sf)
    ref = DEFAULT_RUN.reference_date
    return rounded(A.metrics(ag, A.chosen_months(ag, ref, datetime.date(2024, 7, 1)), ref),
                   {"month_total", "passed", "pending"})


@register("agenda_by_date")
def q_agenda_by_date(spark, sf):
    ag = _agenda(spark, sf)
    return rounded(A.by_date(ag, A.chosen_months(ag, DEFAULT_RUN.reference_date)), {"total"})


@register("agenda_by_ticker")
def q_agenda_by_ticker(spark, sf):
    ag = _agenda(spark, sf)
    return rounded(A.by_ticker(ag, A.chosen_months(ag, DEFAULT_RUN.reference_date)), {"total"})


@register("dividend_calendar")
def q_dividend_calendar(spark, sf):
    ag = A.build(positions(spark, sf, staged=False), DEFAULT_RUN.reference_date)
    per_date = A.default_month_by_date(ag, DEFAULT_RUN.reference_date)
    return rounded(A.calendar(per_date), {f"{d}_value" for d in A.WEEKDAYS_PT})


# ------------------------------------------------------------------- series
SMALL_REF = DEFAULT_RUN.reference_date            # 6-month look-back covers the events month
LARGE_REF, LARGE_PERIOD = datetime.date(2001, 11, 4), "2 anos"
BENCH_SYMS = list(S.BENCHMARK_SYMBOLS.values())


def _small(spark, sf):
    qty = K2.qty_by_ticker(stored_input(spark, sf, "small_holdings"))
    months, _ = S.lookback("6 meses")
    return qty, S.clean_panel(stored_input(spark, sf, "small_panel"), SMALL_REF, months)


def cdi_rates(spark, sf):
    """S4's CDI entries as (series_id, rate_date, rate), the percent / 100."""
    r = SH.rate_series(_payloads(spark, sf, S.CDI_SERIES))
    return r.select("series_id", "rate_date", (F.col("valor") / 100).alias("rate"))


@register("cumulative_index")
def q_cumulative_index(spark, sf):
    idx = S.cumulative_index(cdi_rates(spark, sf))
    return rounded(idx.select("series_id", "rate_date", "cum_index"))


@register("gap_fill")
def q_gap_fill(spark, sf):
    qty, panel = _small(spark, sf)
    return rounded(S.gap_fill(qty, panel, BENCH_SYMS))


@register("portfolio_series")
def q_portfolio_series(spark, sf):
    qty, panel = _small(spark, sf)
    return rounded(S.portfolio_series(qty, panel, BENCH_SYMS), {"value"})


@register("portfolio_series_large")
def q_portfolio_series_large(spark, sf):
    """T4 delta-sum on the large panel (every customer x part holding)."""
    months, _ = S.lookback(LARGE_PERIOD)
    # Dealt by portfolio once, for the sums by ticker and by symbol.
    qty = K2.qty_by_ticker(stored_input(spark, sf, "large_holdings").repartition("portfolio_id"))
    panel = S.clean_panel(stored_input(spark, sf, "large_panel"), LARGE_REF, months)
    return rounded(S.portfolio_series_blocks(qty, panel), {"value"})


@register("benchmark_align")
def q_benchmark_align(spark, sf):
    qty, panel = _small(spark, sf)
    axis = S.portfolio_series(qty, panel, BENCH_SYMS).select("portfolio_id", "date")
    return rounded(S.benchmark_align(axis, panel, ["Ibovespa", "IFIX"]), {"value"})


@register("rate_asof")
def q_rate_asof(spark, sf):
    qty, panel = _small(spark, sf)
    axis = S.portfolio_series(qty, panel, BENCH_SYMS).select("portfolio_id", "date")
    asof = S.rate_asof(axis, S.cumulative_index(cdi_rates(spark, sf), S.DEFAULT_PERIOD[1]))
    return rounded(asof.withColumnRenamed("value", "cum_index"))


def _evolution_inputs(spark, sf):
    qty = K2.qty_by_ticker(stored_input(spark, sf, "small_holdings"))
    return qty, stored_input(spark, sf, "small_panel"), cdi_rates(spark, sf), SMALL_REF, "6 meses"


@register("rebased_series")
def q_rebased_series(spark, sf):
    return rounded(S.evolution(*_evolution_inputs(spark, sf)))


@register("evolution_wide")
def q_evolution_wide(spark, sf):
    return rounded(S.evolution_wide(*_evolution_inputs(spark, sf)))


def _holed_panel(spark, sf):
    """The small panel with closes that are no numbers, as market data has them:
    NaN, inf and -inf on about every fifth row."""
    p = stored_input(spark, sf, "small_panel")
    n = (F.dayofmonth("date") + F.ascii(F.substring("symbol", 4, 1))) % 15
    return p.withColumn("close", F.when(n == 3, float("nan")).when(n == 7, float("inf")).when(n == 11, float("-inf"))
                        .otherwise(F.col("close")))


@register("portfolio_series_holed")
def q_portfolio_series_holed(spark, sf):
    """T9 + T4: closes that are no numbers are gaps."""
    qty = K2.qty_by_ticker(stored_input(spark, sf, "small_holdings"))
    panel = S.clean_panel(_holed_panel(spark, sf), SMALL_REF, S.lookback("6 meses")[0])
    return rounded(S.portfolio_series(qty, panel, BENCH_SYMS), {"value"})


@register("relative_performance")
def q_relative_performance(spark, sf):
    sel = S.default_selection(stored_input(spark, sf, "small_holdings"))
    return rounded(S.relative_performance(sel, stored_input(spark, sf, "small_panel"), SMALL_REF, 6, "IBOV"))


@register("qty_by_ticker")
def q_qty_by_ticker(spark, sf):
    return rounded(K2.qty_by_ticker(positions(spark, sf, staged=False)))


@register("symbol_map")
def q_symbol_map(spark, sf):
    """N20 over every symbol of the panel and every position ticker."""
    syms = (stored_input(spark, sf, "small_panel").select("symbol")
            .unionByName(positions(spark, sf, staged=False).select(T.quote_symbol(F.col("ticker")).alias("symbol"))).distinct())
    return syms.select("symbol", T.series_name(F.col("symbol")).alias("history_name"),
                       T.series_name(F.col("symbol"), evolution=True).alias("evolution_name"))


# --------------------------------------------------------------- indicators
def _raw_pages(spark, sf):
    return H.extract(stored_input(spark, sf, "indicator_pages"))


@register("page_scan")
def q_page_scan(spark, sf):
    return H.page_hits(stored_input(spark, sf, "indicator_pages")).select("page_id", "ticker", "status", "hit")


@register("vp_from_cells")
def q_vp_from_cells(spark, sf):
    raw = _raw_pages(spark, sf).where("hit")
    return rounded(raw.select("page_id", H._last_parsed(F.col("cell_vp")).alias("vp")))


@register("dy_from_cards")
def q_dy_from_cards(spark, sf):
    raw = _raw_pages(spark, sf).where("hit")
    return rounded(raw.select("page_id", H._last_parsed(F.col("card_dy")).alias("dy")))


@register("indicators_table")
def q_indicators_table(spark, sf):
    raw = _raw_pages(spark, sf).where("hit")
    return rounded(raw.select("page_id", "has_table", H._first_table_value(H.VP_KEY).alias("vp"),
                              H._first_table_value(H.DY_TABLE_KEY).alias("dy")))


@register("vp_from_text")
def q_vp_from_text(spark, sf):
    raw = _raw_pages(spark, sf).where("hit")
    return rounded(raw.select("page_id", F.when(F.col("has_table"), T.parse_or_null(F.col("text_vp"))).alias("vp")))


@register("indicators")
def q_indicators(spark, sf):
    return rounded(H.indicators(_raw_pages(spark, sf)).drop("ts"))


@register("quotes")
def q_quotes(spark, sf):
    return rounded(H.quotes(_raw_pages(spark, sf)), {"quote"})


def _lookup_inputs(spark, sf):
    """H7 inputs: every page, a third of which (page_id % 3 = 0) the cache had
    before; every part's ticker is requested (half of them in lower case with
    blanks, to exercise trim + upper)."""
    found = H.indicators(_raw_pages(spark, sf))
    k = F.col("p_partkey")
    req = (FX.table(spark, sf, "part")
           .select(F.when(k % 2 == 0, F.concat(F.lit(" "), F.lower(FX.ticker_from_key(k)), F.lit(" ")))
                   .otherwise(FX.ticker_from_key(k)).alias("ticker")))
    return req, found


@register("indicator_lookup")
def q_indicator_lookup(spark, sf):
    return rounded(H.lookup_pages(*_lookup_inputs(spark, sf), F.col("page_id") % 3 == 0))


@register("indicator_not_found")
def q_indicator_not_found(spark, sf):
    return H.not_found(*_lookup_inputs(spark, sf))


@register("last_known_good")
def q_last_known_good(spark, sf):
    found = H.indicators(H.extract(stored_input(spark, sf, "refresh_pages")))
    return rounded(H.latest(found).drop("ts"))


@register("cache_status")
def q_cache_status(spark, sf):
    found = H.indicators(H.extract(stored_input(spark, sf, "refresh_pages")))
    return H.cache_status(H.latest(found))


# -------------------------------------------------------------- rates, KPIs
def _payloads(spark, sf, series):
    return stored_input(spark, sf, "rate_payloads").where(F.col("series_id") == series)


def _scalars(spark, sf, override=None):
    """One row: inflation (A6 over IPCA), official and used rate."""
    infl = K2.compounded_rate(SH.last_entries(_payloads(spark, sf, "IPCA"), K2.INFLATION_WINDOW))
    named = SH.named_rate(SH.named_rates(stored_input(spark, sf, "named_rate_payload")))
    series_last = SH.last_entries(_payloads(spark, sf, "SELIC"), 1)
    rate = K2.reference_rate(named, series_last, override=override)
    return K2.attach_scalars(infl, rate)


RATE_ENTRIES = 260  # entries that the rate source is asked for (fixed value)


@register("rate_series")
def q_rate_series(spark, sf):
    return rounded(SH.rate_series(stored_input(spark, sf, "rate_payloads"), last_n=RATE_ENTRIES))


@register("named_rate")
def q_named_rate(spark, sf):
    return rounded(SH.named_rate(SH.named_rates(stored_input(spark, sf, "named_rate_payload"))))


@register("compounded_rate")
def q_compounded_rate(spark, sf):
    return rounded(K2.compounded_rate(SH.last_entries(_payloads(spark, sf, "IPCA"), K2.INFLATION_WINDOW)))


@register("reference_rate")
def q_reference_rate(spark, sf):
    return rounded(_scalars(spark, sf).select("official_rate", "used_rate"))


@register("inflation_fallback")
def q_inflation_fallback(spark, sf):
    """A6 over a series with an entry that is no number: the default."""
    return rounded(K2.compounded_rate(SH.last_entries(_payloads(spark, sf, S.CDI_SERIES), K2.INFLATION_WINDOW)))


@register("reference_rate_chain")
def q_reference_rate_chain(spark, sf):
    """A7's branches: the named list, the series, the default, a user's rate."""
    named = SH.named_rate(SH.named_rates(stored_input(spark, sf, "named_rate_payload")))
    series = SH.last_entries(_payloads(spark, sf, "SELIC"), 1)
    none = SH.last_entries(_payloads(spark, sf, "none"), 1)
    cases = {"named": K2.reference_rate(named, series), "series": K2.reference_rate(None, series),
             "default": K2.reference_rate(None, none), "user": K2.reference_rate(named, series, override=0.13)}
    rows = [df.select(F.lit(name).alias("branch"), "official_rate", "used_rate") for name, df in cases.items()]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


def _kpis(spark, sf):
    return K2.portfolio_kpis(positions(spark, sf, staged=False), _scalars(spark, sf), DEFAULT_RUN.income_goal)


KPI_MONEY = {"total_invested", "monthly_income", "funds_value", "stocks_value", "variable_income_value",
             "other_value", "upkeep", "real_income", "inflation_cost", "return_value"}


@register("portfolio_kpis")
def q_portfolio_kpis(spark, sf):
    return rounded(_kpis(spark, sf).select(
        "portfolio_id", "total_value", "total_invested", "monthly_income", "funds_value", "stocks_value",
        "variable_income_value", "other_value", "variable_share", "other_share", "return_value", "return_pct",
        "return_class"), KPI_MONEY)


@register("real_income")
def q_real_income(spark, sf):
    return rounded(_kpis(spark, sf).select(
        "portfolio_id", "inflation", "monthly_inflation", "upkeep", "real_income", "nominal_yield",
        "real_yield", "inflation_cost"), KPI_MONEY)


@register("goal_progress")
def q_goal_progress(spark, sf):
    return rounded(_kpis(spark, sf).select("portfolio_id", "real_income", "goal_progress", "goal_bar"), KPI_MONEY)


@register("masked_kpis")
def q_masked_kpis(spark, sf):
    k = _kpis(spark, sf)
    return K2.masked_kpis(k, False).unionByName(K2.masked_kpis(k, True).withColumn(
        "portfolio_id", -F.col("portfolio_id")))


@register("rate_delta_label")
def q_rate_delta_label(spark, sf):
    """N23 on a per-portfolio used rate: official + (id % 3 - 1) / 100."""
    k = _kpis(spark, sf)
    used = F.col("official_rate") + (F.col("portfolio_id") % 3 - 1) / 100.0
    text, cls = T.rate_delta_label(used, F.col("official_rate"))
    return k.select("portfolio_id", text.alias("rate_delta_text"), cls.alias("rate_delta_class"))


# ---------------------------------------------------------- sources, report
@register("source_locator")
def q_source_locator(spark, sf):
    """S3 over sheet links derived from every page URL."""
    pg = FX.table(spark, sf, "pages")
    key = F.substring(F.sha2(F.col("url"), 256), 1, 20)
    m = F.col("page_id") % 5
    link = (F.when(m == 0, F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), key, F.lit("/edit#gid="),
                                    F.col("page_id").cast("string")))
            .when(m == 1, F.concat(F.lit("https://docs.google.com/spreadsheets/d/e/"), key, F.lit("/pubhtml?gid=7")))
            .when(m == 2, F.concat(F.lit("https://docs.google.com/spreadsheets/d/e/"), key))
            .when(m == 3, F.col("url"))
            .otherwise(F.lit("")))
    loc = SH.locate(link)
    return pg.select("page_id", loc["doc_id"].alias("doc_id"), loc["tab_id"].alias("tab_id"))


SNAP_TS = datetime.datetime(2024, 6, 15, 8, 30, 0)


def _snapshot(spark, sf):
    """Write two snapshots (an older one with values x 0.9) into a fresh
    folder under the shared checkpoint directory; return the latest read."""
    path = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    pos = positions(spark, sf, *SH.SNAPSHOT_COLUMNS, "invested", "monthly_income")
    k = stage(K2.portfolio_kpis(pos, _scalars(spark, sf), DEFAULT_RUN.income_goal), "kpis")
    older = pos.withColumn("market_value", F.col("market_value") * 0.9)
    SH.write_snapshot(older, k.withColumn("total_value", F.col("total_value") * 0.9), path,
                      SNAP_TS - datetime.timedelta(days=1))
    SH.write_snapshot(pos, k, path, SNAP_TS)
    return SH.read_latest_snapshot(spark, path)


@register("snapshot_roundtrip")
def q_snapshot_roundtrip(spark, sf):
    _, p = _snapshot(spark, sf)
    return rounded(p.select("portfolio_id", *SH.SNAPSHOT_COLUMNS))


@register("snapshot_latest")
def q_snapshot_latest(spark, sf):
    t, _ = _snapshot(spark, sf)
    return rounded(t.select("portfolio_id", "total_value", "total_invested",
                            F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss").alias("snapshot_ts")),
                   {"total_invested"})


@register("totals_text")
def q_totals_text(spark, sf):
    """N5 -> N2: the totals as the report's sheet holds them, in text, and read
    back by the strict parser."""
    t, _ = _snapshot(spark, sf)
    read = {c: T.parse_strict(T.fmt_currency(F.col(c))).alias(c) for c in ("total_value", "total_invested")}
    return t.select("portfolio_id", *read.values())


@register("morning_report")
def q_morning_report(spark, sf):
    t, _ = _snapshot(spark, sf)
    return rounded(R.morning_row(t), {"total_invested", "profit"})


@register("report_context")
def q_report_context(spark, sf):
    t, p = _snapshot(spark, sf)
    return R.context(p, t)


def powers_of_ten(x, n):
    """x times 1e-12 to 1e20 by n % 33, to reach every notation of a number."""
    factor = F.lit(1e20)
    for i in range(32):
        factor = F.when(n % 33 == i, F.lit(float(f"1e{i - 12}"))).otherwise(factor)
    return x * factor


@register("report_context_wide")
def q_report_context_wide(spark, sf):
    """R2 with prices of every magnitude (quantity times a power of ten)."""
    p = positions(spark, sf)
    k = K2.portfolio_kpis(p, _scalars(spark, sf), DEFAULT_RUN.income_goal)
    return R.context(p.withColumn("price", powers_of_ten(F.col("quantity"), F.col("row_idx"))), k)


@register("number_text")
def q_number_text(spark, sf):
    """Python's number text over every line item, at every magnitude."""
    li = FX.table(spark, sf, "lineitem")
    x = powers_of_ten(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_orderkey") + F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", T.py_number(x).alias("text"))


# --------------------------------------------------------- scalar functions
@register("parse_to_f")
def q_parse_to_f(spark, sf):
    s = fund_sheet(spark, sf)
    return rounded(s.select("portfolio_id", "row_idx", T.parse_or_zero(F.col("_c5")).alias("quantity"),
                            T.parse_or_zero(F.col("_c8")).alias("price"),
                            T.parse_or_zero(F.col("_c11")).alias("book_value"),
                            T.parse_or_zero(F.col("_c17")).alias("dy_raw")), {"dy_raw"})


@register("parse_nullable")
def q_parse_nullable(spark, sf):
    s = fund_sheet(spark, sf)
    return rounded(s.select("portfolio_id", "row_idx", T.parse_or_null(F.col("_c11")).alias("book_value"),
                            T.parse_or_null(F.col("_c9")).alias("avg_cost")))


@register("scale_dy")
def q_scale_dy(spark, sf):
    s = fund_sheet(spark, sf)
    return rounded(s.select("portfolio_id", "row_idx", T.scale_dy(T.parse_or_zero(F.col("_c17"))).alias("dy_12m")))


@register("fmt_currency")
def q_fmt_currency(spark, sf):
    return positions(spark, sf, staged=False).select("portfolio_id", "ticker", "asset_type",
                                                     T.fmt_currency(F.col("market_value")).alias("value_text"))


@register("fmt_percent")
def q_fmt_percent(spark, sf):
    return positions(spark, sf, staged=False).select("portfolio_id", "ticker", "asset_type",
                                                     T.fmt_percent(F.col("dy_12m")).alias("dy_text"))


@register("valid_ticker")
def q_valid_ticker(spark, sf):
    s = fund_sheet(spark, sf)
    return s.select("portfolio_id", "row_idx", T.is_valid_ticker(T.clean_key(F.col("_c0"))).alias("valid"))


@register("normalize_sector")
def q_normalize_sector(spark, sf):
    return positions(spark, sf, staged=False).select("portfolio_id", "ticker", "asset_type",
                                                     T.normalize_sector(F.col("sector")).alias("sector_norm"))


@register("resolve_ex_date")
def q_resolve_ex_date(spark, sf):
    f = P.fund_positions(fund_sheet(spark, sf))
    return D.with_ex_date(f, "ex_date_text", DEFAULT_RUN.reference_date, "ex_date").select(
        "portfolio_id", "row_idx", "ex_date")


@register("nth_business_day")
def q_nth_business_day(spark, sf):
    """N12 for every part: month 2024-01 + k % 24, N = k % 25 (0 -> null)."""
    k = F.col("p_partkey")
    m0 = F.add_months(F.lit("2024-01-01").cast("date"), (k % 24).cast("int"))
    return FX.table(spark, sf, "part").select(k.alias("k"), m0.alias("month_start"), (k % 25).cast("int").alias("n"),
                                              D.nth_business_day(m0, (k % 25).cast("int")).alias("business_day"))


@register("last_business_day")
def q_last_business_day(spark, sf):
    """N13 for every month with orders."""
    m0 = F.trunc(F.to_date("o_orderdate"), "month")
    return (FX.table(spark, sf, "orders").select(m0.alias("month_start")).distinct()
            .select("month_start", D.last_business_day(F.col("month_start")).alias("last_business_day")))


@register("month_label")
def q_month_label(spark, sf):
    """N14 for every month with orders."""
    m0 = F.trunc(F.to_date("o_orderdate"), "month")
    return (FX.table(spark, sf, "orders").select(m0.alias("month_start")).distinct()
            .select("month_start", T.month_label(F.col("month_start")).alias("label")))


@register("strip_fences")
def q_strip_fences(spark, sf):
    """N21 on whole document texts wrapped in fences."""
    docs = FX.table(spark, sf, "documents")
    s = T.strip_fences(F.concat(F.lit("```html\n"), F.col("text"), F.lit("\n```")))
    return docs.select("doc_id", F.length(s).cast("bigint").alias("n_chars"), F.sha2(s, 256).alias("digest"))


@register("price_panel")
def q_price_panel(spark, sf):
    """Closes of the held symbols and the benchmarks over the 6-month
    look-back (a predicate on the panel's months and dates)."""
    months, _ = S.lookback("6 meses")
    qty = K2.qty_by_ticker(stored_input(spark, sf, "small_holdings"))
    return rounded(S.price_panel(qty, stored_input(spark, sf, "small_panel"), SMALL_REF, months, BENCH_SYMS))


REFRESH_SCHEMA = "page_id long, ticker string, url string, final_url string, status int, ts timestamp, html string"


@register("last_known_good_stream")
def q_last_known_good_stream(spark, sf):
    """H8 run as the Structured Streaming job: the refresh pages land as
    several files in the shared folder, the stream processes them
    (availableNow), and the newest version of the keyed table is returned."""
    run = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    pages = stored_input(spark, sf, "refresh_pages")
    pages.write.option("maxRecordsPerFile", 1000).parquet(f"{run}/pages")
    q = RS.refresh_stream(spark, f"{run}/pages", REFRESH_SCHEMA, f"{run}/latest", f"{run}/checkpoint")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return rounded(RS.read_latest_version(spark, f"{run}/latest").select("ticker", "vp", "dy", "page_id"))
