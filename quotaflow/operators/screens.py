"""Screens, sorts and top-k, per portfolio.

Per-portfolio scalars (means, totals) come from a partial aggregate joined
back on ``portfolio_id``; top-k uses ``row_number() <= k`` which Spark plans
as a partial WindowGroupLimit before the exchange, so a hot portfolio is cut
to k rows per map task before anything is shuffled. Unlimited listings are
not sorted here; whoever shows them sorts what is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.functions import numeric as N
from quotaflow.functions import text as T
from quotaflow.operators import positions as P
from quotaflow.params import OFFICIAL, ScreenParams, columns_of

# Fixed values of the screens (must equal the reference's).
OPPORTUNITY_TOP = 4
RADAR_TOP = 4
REPORT_TOP = 15
EXPENSIVE_PVP = 1.1           # 'Caro' above this P/VP
TRAP_PVP, TRAP_DY = 0.7, 0.08  # 'Armadilha' below both
LOW_YIELD_MEAN_SHARE = 0.85    # 'Baixo Yield' floor as a share of the mean DY
DISCOUNT_LOW, DISCOUNT_HIGH = 0.1, 1.0
VALUE_BOX_DY_HEADROOM = 1.1
REASON_SEP = " + "
EXPENSIVE, LOW_YIELD, TRAP, WATCH = "Caro", "Baixo Yield", "Armadilha", "Observação"


def portfolio_means(positions: DataFrame) -> DataFrame:
    """A1/A10: per portfolio total value, mean weight and mean DY over *all*
    rows (non-funds count with DY 0; NaN skipped as pandas does).

    The weights of a portfolio with a positive total sum to exactly 1, so
    their mean is 1/n and ``total * mean weight`` is ``total / n``
    (``target_value``); both are computed in that exact form from a
    fixed-point total, so screens do not flip with summation order."""
    agg = positions.groupBy("portfolio_id").agg(
        N.exact_money_sum(F.col("market_value")).alias("total_value"),
        F.count(F.lit(1)).alias("n_positions"),
        F.avg(N.finite_or_null(F.col("dy_12m"))).alias("mean_dy"),
    )
    cols = _mean_columns(F.col("total_value"), F.col("n_positions"), F.col("mean_dy"))
    return agg.select("portfolio_id", *[c.alias(k) for k, c in cols.items()])


def _mean_columns(total: Column, n: Column, mean_dy: Column) -> dict[str, Column]:
    positive = total > 0
    return {"total_value": total, "n_positions": n,
            "mean_weight": F.when(positive, 1.0 / n).otherwise(F.lit(0.0)),
            "target_value": F.when(positive, total / n).otherwise(F.lit(0.0)),
            "mean_dy": mean_dy}


def with_means(positions: DataFrame) -> DataFrame:
    """Positions with their portfolio's total, mean weight, target value and
    mean DY. Read from the figures ``with_weights`` left on the rows when
    present (no extra pass); else one aggregate joined back."""
    if all(c in positions.columns for c in P.PORTFOLIO_STATS):
        return positions.withColumns(_mean_columns(F.col("pf_total_value"), F.col("pf_n_positions"),
                                                   F.col("pf_mean_dy")))
    return positions.join(portfolio_means(positions), "portfolio_id", "left")


def _top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("portfolio_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def opportunities(positions: DataFrame, params: ScreenParams | None, k: int = OPPORTUNITY_TOP,
                  privacy: bool | Column = False) -> DataFrame:
    """K1: FII with P/VP in [min, max], DY >= min and weight strictly below
    the mean weight; contribution = max(0, total*mean weight - value) must be
    >= min; order P/VP asc, DY desc, contribution desc, then source order;
    top k per portfolio. ``params`` None reads each row's own
    (``params.with_params``). In privacy mode (N18) the section is empty."""
    p = columns_of(params)
    cand = with_means(positions).where(
        (F.col("asset_type") == "FII")
        & (F.col("price_to_book") >= p["pvp_min"]) & (F.col("price_to_book") <= p["pvp_max"])
        & (F.col("dy_12m") >= p["dy_min"]) & _shown(privacy)
    ).where(F.col("weight") < F.col("mean_weight"))
    cand = cand.withColumn(
        "suggested_contribution",
        F.greatest(F.lit(0.0), F.col("target_value") - F.col("market_value")),
    ).where(F.col("suggested_contribution") >= p["contribution_min"])
    top = _top_k(cand, k, F.col("price_to_book").asc(), F.col("dy_12m").desc(),
                 F.col("suggested_contribution").desc(), F.col("source_rank"), F.col("row_idx"))
    return top.select("portfolio_id", "rank", "ticker", "sector", "segment", "price", "price_to_book",
                      "dy_12m", "weight", "market_value", "suggested_contribution", "link")


def _shown(privacy: bool | Column) -> Column:
    """The two card sections are left out in privacy mode."""
    return ~(privacy if isinstance(privacy, Column) else F.lit(privacy))


def classify_risk(positions: DataFrame, params: ScreenParams | None, official_rate: float | Column | None = None) -> DataFrame:
    """K2: reasons, rank and label for every FII row. ``params`` None reads each
    row's own parameters and rate (``params.with_params``).

    Rank/label: Baixo Yield + Armadilha -> 0; Baixo Yield -> 1; Caro -> 2;
    any other reasons -> 3 (joined); none -> 99 'Observação'. P/VP 0 counts
    as < 0.7."""
    p = columns_of(params)
    if params is None:
        official = F.col(OFFICIAL)
    else:
        official = official_rate if isinstance(official_rate, Column) else F.lit(float(official_rate))
    limit = F.when(p["selic"] > 0, p["selic"]).otherwise(official)
    funds = with_means(positions).where(F.col("asset_type") == "FII")
    brick = (F.col("segment") == T.BRICK_LABEL) if "segment" in positions.columns else T.is_brick(F.col("sector"))
    share = F.when(brick, p["brick_pct"]).otherwise(p["paper_pct"])
    floor_dy = F.col("mean_dy") * LOW_YIELD_MEAN_SHARE
    threshold = F.when(limit > 0, F.greatest(floor_dy, limit * share)).otherwise(floor_dy)
    pvp, dy = F.col("price_to_book"), F.col("dy_12m")
    expensive = pvp > EXPENSIVE_PVP
    low = dy < threshold
    trap = (pvp < TRAP_PVP) & (dy < TRAP_DY)
    reasons = F.concat_ws(REASON_SEP, F.when(expensive, F.lit(EXPENSIVE)), F.when(low, F.lit(LOW_YIELD)),
                          F.when(trap, F.lit(TRAP)))
    none = ~(expensive | low | trap)
    rank = (F.when(none, 99).when(low & trap, 0).when(low, 1).when(expensive, 2).otherwise(3))
    label = (F.when(none, F.lit(WATCH)).when(low & trap, F.lit(f"{LOW_YIELD}{REASON_SEP}{TRAP}"))
             .when(low, F.lit(LOW_YIELD)).when(expensive, F.lit(EXPENSIVE)).otherwise(reasons))
    return funds.withColumns({
        "risk_reasons": F.when(none, F.lit(WATCH)).otherwise(reasons),
        "risk_rank": rank.cast("int"),
        "risk_label": label,
    }).drop("total_value", "n_positions", "mean_weight", "target_value", "mean_dy")


def risk_radar(classified: DataFrame, k: int = RADAR_TOP, privacy: bool | Column = False) -> DataFrame:
    """K3: drop 'Observação'; rank asc, value desc, source order; top k. In
    privacy mode (N18) the section is empty."""
    flagged = classified.where((F.col("risk_reasons") != WATCH) & _shown(privacy))
    top = _top_k(flagged, k, F.col("risk_rank"), F.col("market_value").desc(), F.col("source_rank"), F.col("row_idx"))
    return top.select("portfolio_id", "rank", "ticker", "sector", "segment", "price", "avg_cost", "price_to_book",
                      "dy_12m", "weight", "market_value", "risk_reasons", "risk_rank", "risk_label", "link")


def value_matrix(positions: DataFrame) -> DataFrame:
    """K4: FII with P/VP > 0, flagged inside the favourable box
    0 <= P/VP <= 1 and mean DY <= DY <= 1.1 * max DY (max over these rows)."""
    box = (F.col("asset_type") == "FII") & (F.col("price_to_book") > 0)
    if "pf_max_dy_box" in positions.columns:
        m = with_means(positions).where(box).withColumn("max_dy", F.col("pf_max_dy_box"))
    else:
        funds = with_means(positions).where(box)
        max_dy = funds.groupBy("portfolio_id").agg(F.max("dy_12m").alias("max_dy"))
        m = funds.join(max_dy, "portfolio_id")
    inside = ((F.col("price_to_book") >= 0) & (F.col("price_to_book") <= 1.0)
              & (F.col("dy_12m") >= F.col("mean_dy"))
              & (F.col("dy_12m") <= F.col("max_dy") * VALUE_BOX_DY_HEADROOM))
    return m.select("portfolio_id", "ticker", "price_to_book", "dy_12m", "market_value",
                    inside.alias("in_value_box"))


def best_discounts(positions: DataFrame) -> DataFrame:
    """K5: FII with 0.1 < P/VP < 1.0. Shown by ascending P/VP; readers sort."""
    return (positions.where((F.col("asset_type") == "FII") & (F.col("price_to_book") < DISCOUNT_HIGH)
                            & (F.col("price_to_book") > DISCOUNT_LOW))
            .select("portfolio_id", "ticker", "price", "price_to_book", "dy_12m", "market_value", "weight"))


# Fixed column order of the inventory table (Link shown as Ficha).
INVENTORY_ORDER = ["detail_link", "ticker", "segment", "sector", "avg_cost", "price", "quantity",
                   "market_value", "return_pct", "dy_12m", "weight", "monthly_income"]


def inventory(positions: DataFrame) -> DataFrame:
    """K6: the twelve inventory columns that exist, in fixed order."""
    df = positions.withColumnRenamed("link", "detail_link") if "link" in positions.columns \
        else positions.withColumn("detail_link", F.lit(None).cast("string"))
    keep = ["portfolio_id"] + [c for c in INVENTORY_ORDER if c in df.columns]
    return df.select(*keep)


def top_by_value(df: DataFrame, k: int = REPORT_TOP) -> DataFrame:
    """K7: top k rows by value per portfolio, with the optional report
    columns that exist (ticker breaks ties)."""
    top = _top_k(df, k, F.col("market_value").desc(), F.col("ticker"))
    optional = [c for c in ["ticker", "asset_type", "price", "price_to_book", "dy_12m"] if c in df.columns]
    return top.select("portfolio_id", "rank", *optional, "market_value")
