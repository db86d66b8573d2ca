"""Position build: two sheet branches -> quote
enrichment -> union -> keep-first dedup -> valuation -> weights -> segment.

All row logic is column expressions. The only shuffles are the dedup
(hash on portfolio, ticker, type, with a per-partition group limit before the
exchange) and the per-portfolio total (partial aggregation, then a join that
AQE broadcasts when the measured side is small or splits when skewed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.functions import numeric as N
from quotaflow.functions import text as T
from quotaflow.session import stage

# Fixed values of the sheets (column positions of the fund sheet and the
# row keys the manual branch skips).
COL_TICKER, COL_QTY, COL_PRICE, COL_AVG_COST, COL_BOOK, COL_DY, COL_EX_DATE, COL_SECTOR = 0, 5, 8, 9, 11, 17, 20, 24
MANUAL_SKIP = ["ATIVO", "TOTAL", "", "NAN"]
FUND, STOCK, OTHER = "FII", "Ação", "Outros"
STOCK_SECTOR, OTHER_SECTOR = "Ações", "Ação/Outros"

POSITION_COLUMNS = [
    "portfolio_id", "source_rank", "row_idx", "ticker", "asset_type", "sector", "quantity",
    "avg_cost", "price", "book_value", "dy_12m", "ex_date_text", "link",
]
SCRUBBED = ["market_value", "invested", "price", "book_value", "dy_12m", "monthly_income", "profit", "avg_cost"]


def _positive(x: Column) -> Column:
    """Python ``x > 0`` (False for NaN; Spark orders NaN above everything)."""
    return ~F.isnan(x) & (x > 0)


def _cell(df: DataFrame, idx: int) -> Column | None:
    name = f"_c{idx}"
    return F.col(name) if name in df.columns else None


def fund_positions(sheet: DataFrame) -> DataFrame:
    """Positional fund sheet -> FII positions (valid ticker, qty > 0).

    A missing sector column gives 'Indefinido', a missing date column '-';
    any other missing column means no row qualifies (the reference skips it).
    """
    required = [COL_TICKER, COL_QTY, COL_PRICE, COL_AVG_COST, COL_BOOK, COL_DY]
    if any(_cell(sheet, i) is None for i in required):
        return sheet.limit(0).select(*_empty_position_cols())
    sector_cell = _cell(sheet, COL_SECTOR)
    date_cell = _cell(sheet, COL_EX_DATE)
    keyed = T.once(sheet.withColumn("ticker", T.clean_key(_cell(sheet, COL_TICKER))), "ticker").where(
        T.is_valid_ticker(F.col("ticker")))
    parsed = T.with_parsed(keyed, {
        "quantity": ("zero", f"_c{COL_QTY}"), "avg_cost": ("zero", f"_c{COL_AVG_COST}"),
        "price": ("zero", f"_c{COL_PRICE}"), "book_value": ("zero", f"_c{COL_BOOK}"),
        "dy_raw": ("zero", f"_c{COL_DY}")})
    out = T.once(parsed, "quantity").where(_positive(F.col("quantity"))).select(
        "portfolio_id",
        F.lit(0).alias("source_rank"),
        F.col("row_idx").cast("bigint").alias("row_idx"),
        "ticker",
        F.lit(FUND).alias("asset_type"),
        (T.sector_or_default(sector_cell) if sector_cell is not None else F.lit(T.DEFAULT_SECTOR)).alias("sector"),
        "quantity", "avg_cost", "price", "book_value",
        T.scale_dy(F.col("dy_raw")).alias("dy_12m"),
        (F.coalesce(T.strip_py(date_cell), F.lit("-")) if date_cell is not None else F.lit("-")).alias("ex_date_text"),
        T.asset_link(F.col("ticker"), F.lit(FUND)).alias("link"),
    )
    return out


def _empty_position_cols() -> list[Column]:
    types = {"portfolio_id": "bigint", "source_rank": "int", "row_idx": "bigint", "quantity": "double",
             "avg_cost": "double", "price": "double", "book_value": "double", "dy_12m": "double"}
    return [F.lit(None).cast(types.get(c, "string")).alias(c) for c in POSITION_COLUMNS]


def manual_positions(sheet: DataFrame) -> DataFrame:
    """Headed manual sheet (first four columns, any names) -> stocks and
    other assets. Stocks: cost = sheet value; others: qty 1, cost 0. No
    qty > 0 test. ``sheet_value`` is kept for the quote enrichment (P3)."""
    data_cols = [c for c in sheet.columns if c not in ("portfolio_id", "row_idx")]
    if len(data_cols) < 4:
        return sheet.limit(0).select(*_empty_position_cols(), F.lit(None).cast("double").alias("sheet_value"))
    c_ticker, c_type, c_qty, c_value = (F.col(f"`{c}`") for c in data_cols[:4])
    keyed = T.once(sheet.select(
        "portfolio_id", "row_idx",
        T.clean_key(c_ticker.cast("string")).alias("ticker"),
        T.clean_key(c_type.cast("string")).alias("_type"),
        c_qty.cast("string").alias("_qty"), c_value.cast("string").alias("_value"),
    ), "ticker").where(~F.col("ticker").isin(*MANUAL_SKIP))
    parsed = T.with_parsed(keyed, {"_q": ("zero", "_qty"), "_v": ("zero", "_value")})
    is_stock = F.col("_type").contains("AÇÃO") | F.col("_type").contains("ACAO")
    kind = F.when(is_stock, F.lit(STOCK)).otherwise(F.lit(OTHER))
    return parsed.select(
        "portfolio_id",
        F.lit(1).alias("source_rank"),
        F.col("row_idx").cast("bigint").alias("row_idx"),
        "ticker",
        kind.alias("asset_type"),
        F.when(is_stock, F.lit(STOCK_SECTOR)).otherwise(F.lit(OTHER_SECTOR)).alias("sector"),
        F.when(is_stock, F.col("_q")).otherwise(F.lit(1.0)).alias("quantity"),
        F.when(is_stock, F.col("_v")).otherwise(F.lit(0.0)).alias("avg_cost"),
        F.col("_v").alias("price"),
        F.lit(0.0).alias("book_value"),
        F.lit(0.0).alias("dy_12m"),
        F.lit("-").alias("ex_date_text"),
        T.asset_link(F.col("ticker"), kind).alias("link"),
        F.col("_v").alias("sheet_value"),
    )


def enrich_quotes(manual: DataFrame, quotes: DataFrame) -> DataFrame:
    """A stock's price is its live quote when > 0, else the sheet value.

    One left join against the quote table (one row per ticker); AQE
    broadcasts it when its measured size is under the threshold."""
    q = quotes.select(F.col("ticker").alias("_q_ticker"), F.col("quote").alias("_quote"))
    joined = manual.join(q, (manual.ticker == q._q_ticker) & (manual.asset_type == STOCK), "left")
    price = F.when(_positive(F.coalesce(F.col("_quote"), F.lit(0.0))), F.col("_quote")).otherwise(F.col("sheet_value"))
    return joined.withColumn("price", F.when(F.col("asset_type") == STOCK, price).otherwise(F.col("price"))) \
        .drop("_q_ticker", "_quote", "sheet_value")


def union_positions(funds: DataFrame, manual: DataFrame) -> DataFrame:
    """Funds first (source_rank 0), then the manual branch (1)."""
    return funds.select(*POSITION_COLUMNS).unionByName(manual.select(*POSITION_COLUMNS))


def dedup_keep_first(df: DataFrame) -> DataFrame:
    """P5: keep the first row per (portfolio, ticker, type) in source order.

    ``row_number() == 1`` is planned with a partial WindowGroupLimit before
    the exchange, so a hot group of copies is cut per map task."""
    w = Window.partitionBy("portfolio_id", "ticker", "asset_type").orderBy("source_rank", "row_idx")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def valuation(df: DataFrame) -> DataFrame:
    """P6 + N19: value, invested, profit, income; then +-inf -> 0 on all
    numeric columns and NaN -> 0 on the eight listed ones; then P/VP and
    return with > 0 guards (the order matters). Two projections: the raw
    figures, then the scrubbed figures and the ratios read from them."""
    holds_units = F.col("asset_type").isin(FUND, STOCK)
    qty, price, cost = F.col("quantity"), F.col("price"), F.col("avg_cost")
    value = F.when(holds_units, qty * price).otherwise(price)
    invested = F.when(holds_units & _positive(cost), qty * cost).otherwise(value)
    raw = df.withColumns({
        "market_value": value,
        "invested": invested,
        "profit": value - invested,
        "monthly_income": F.when(F.col("asset_type") == FUND, value * F.col("dy_12m") / 12).otherwise(F.lit(0.0)),
    })

    def scrub(c: str) -> Column:
        x = F.when(F.abs(F.col(c)) == float("inf"), F.lit(0.0)).otherwise(F.col(c))
        return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) if c in SCRUBBED else x

    clean = {c: scrub(c) for c in ["quantity"] + SCRUBBED}
    pos = lambda c: clean[c] > 0
    return raw.withColumns({
        **clean,
        "price_to_book": F.when(pos("book_value"), clean["price"] / clean["book_value"]).otherwise(F.lit(0.0)),
        "return_pct": F.when(pos("invested"), clean["market_value"] / clean["invested"] - 1).otherwise(F.lit(0.0)),
    })


# Per-portfolio figures carried on every position row by ``with_weights``.
PORTFOLIO_STATS = ["pf_total_value", "pf_n_positions", "pf_mean_dy", "pf_max_dy_box"]


def portfolio_totals(df: DataFrame) -> DataFrame:
    """Per-portfolio figures of the weights and the screens, in one partial
    aggregate: exact total value, number of rows, mean DY over all rows
    (NaN skipped), and the largest DY among funds with P/VP > 0 (K4)."""
    fund_box = (F.col("asset_type") == FUND) & (F.col("price_to_book") > 0)
    return df.groupBy("portfolio_id").agg(
        N.exact_money_sum(F.col("market_value")).alias("pf_total_value"),
        F.count(F.lit(1)).alias("pf_n_positions"),
        F.avg(N.finite_or_null(F.col("dy_12m"))).alias("pf_mean_dy"),
        F.max(F.when(fund_box, F.col("dy_12m"))).alias("pf_max_dy_box"),
    )


def with_weights(df: DataFrame) -> DataFrame:
    """weight = value / portfolio total; 0 when the total is <= 0.

    The per-portfolio aggregate is joined back once (AQE broadcasts it when
    small, else sort-merge with skew splitting, so a portfolio with a third
    of all rows is spread over tasks); its other figures stay on the rows
    for the screens, which then need no second pass over the positions."""
    tot = portfolio_totals(df)
    # Every row has its portfolio's totals, so a left join equals the inner
    # join; it also lets only the aggregate side be broadcast, so the rows
    # keep their own partitioning instead of that of a tiny coalesced side.
    return df.join(tot, "portfolio_id", "left").withColumn(
        "weight", F.when(F.col("pf_total_value") > 0, F.col("market_value") / F.col("pf_total_value"))
        .otherwise(F.lit(0.0)))


def with_segment(df: DataFrame) -> DataFrame:
    """P8: 'Tijolo'/'Papéis' from the sector for every row."""
    return df.withColumn("segment", T.segment(F.col("sector")))


def valued(fund_sheet: DataFrame, manual_sheet: DataFrame, quotes: DataFrame) -> DataFrame:
    """The sheets' positions, each once, with their figures."""
    funds = fund_positions(fund_sheet)
    manual = enrich_quotes(manual_positions(manual_sheet), quotes)
    # The link follows from what is kept: it is made afterwards, not sorted and sent.
    kept = union_positions(funds, manual).drop("link").transform(dedup_keep_first)
    return kept.withColumn("link", T.asset_link(F.col("ticker"), F.col("asset_type"))).select(*POSITION_COLUMNS).transform(valuation)


# What the weights and the segment read.
STAGED_ALWAYS = ["portfolio_id", "asset_type", "sector", "market_value", "price_to_book", "dy_12m"]


def build(fund_sheet: DataFrame, manual_sheet: DataFrame, quotes: DataFrame, staged: bool = False,
          columns: list[str] | None = None) -> DataFrame:
    """P1-P8 end to end. The weights read the positions twice (totals, then
    rows); ``staged`` writes them to the shared folder first, so that the sheets
    are parsed and the copies dropped once however many readers follow.
    ``columns`` names those of P1-P6 that the readers use: no others are written,
    nor sorted and shuffled before. A single reader that uses no figure of
    ``with_weights`` needs no staging: the planner leaves its join out."""
    rows = valued(fund_sheet, manual_sheet, quotes)
    if staged:
        wanted = None if columns is None else {*STAGED_ALWAYS, *columns}
        rows = stage(rows.select(*[c for c in rows.columns if wanted is None or c in wanted]), "positions")
    return rows.transform(with_weights).transform(with_segment)
