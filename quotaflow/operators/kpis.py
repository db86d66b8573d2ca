"""Portfolio KPIs.

Per-portfolio figures are one partial aggregate. Scalar market inputs
(inflation, reference rate) are one-row global aggregates; they are attached
as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.functions import numeric as N
from quotaflow.functions import text as T

# Fixed fallbacks of the rate sources (must equal the reference's).
INFLATION_FALLBACK = 0.045
REFERENCE_RATE_FALLBACK = 0.12
INFLATION_WINDOW = 12


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row of ``df``: one scalar
    subquery, no join."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.select("*", *[row[c].alias(c) for c in one_row.columns])


def compounded_rate(entries: DataFrame, default: float = INFLATION_FALLBACK) -> DataFrame:
    """prod(1 + v/100) - 1 over the given entries (S4's last 12 of the
    series, ``valor`` null when not a number). The fallback ``default``
    applies when there are no entries (the source failed) or any entry is
    not a number (the reference's loop aborts). One row: ``inflation``."""
    agg = entries.agg(F.product(1 + F.col("valor") / 100).alias("p"),
                      F.count(F.lit(1)).alias("n"), F.count("valor").alias("n_num"))
    ok = (F.col("n") > 0) & (F.col("n") == F.col("n_num"))
    return agg.select(F.when(ok, F.col("p") - 1).otherwise(F.lit(default)).alias("inflation"))


def reference_rate(named_hit: DataFrame | None, series_last: DataFrame | None,
                   default: float = REFERENCE_RATE_FALLBACK, override: float | None = None) -> DataFrame:
    """The named-rate hit (S5, one row ``rate``), else the last entry of
    the series (one row ``valor`` percent, null when not a number) / 100,
    else ``default``; an ``override`` > 0 becomes the used rate. One row:
    ``official_rate``, ``used_rate``."""
    parts = []
    if named_hit is not None:
        parts.append(named_hit.select(F.col("rate").alias("r0")))
    if series_last is not None:
        last = series_last.agg(F.max_by(F.col("valor"), F.col("rate_date")).alias("v"))
        parts.append(last.select((F.col("v") / 100).alias(f"r{len(parts)}")))
    if not parts:
        raise ValueError("reference_rate needs at least one source")
    out = parts[0]
    for extra in parts[1:]:
        out = attach_scalars(out, extra)
    official = F.coalesce(*[F.col(f"r{i}") for i in range(len(parts))], F.lit(default))
    used = F.lit(float(override)) if override and override > 0 else official
    return out.select(official.alias("official_rate"), used.alias("used_rate"))


def portfolio_kpis(positions: DataFrame, scalars: DataFrame, income_goal: float) -> DataFrame:
    """A1-A5 per portfolio. ``scalars`` is one row with ``inflation``,
    ``official_rate`` and ``used_rate`` (a global aggregate, attached as a
    scalar subquery). Money totals are exact
    fixed-point sums."""
    v = F.col("market_value")
    agg = positions.groupBy("portfolio_id").agg(
        N.exact_money_sum(v).alias("total_value"),
        N.exact_money_sum(F.col("monthly_income")).alias("monthly_income"),
        N.exact_money_sum(F.col("invested")).alias("total_invested"),
        N.exact_money_sum(F.when(F.col("asset_type") == "FII", v)).alias("funds_value"),
        N.exact_money_sum(F.when(F.col("asset_type") == "Ação", v)).alias("stocks_value"),
    )
    k = attach_scalars(agg, scalars)
    total, income, invested, infl = (F.col("total_value"), F.col("monthly_income"),
                                     F.col("total_invested"), F.col("inflation"))
    monthly_infl = F.pow(1 + infl, F.lit(1.0 / 12)) - 1
    upkeep = total * monthly_infl
    real_income = income - upkeep
    nominal_yield = F.when(total > 0, income * 12 / total).otherwise(F.lit(0.0))
    variable = F.col("funds_value") + F.col("stocks_value")
    others = F.greatest(total - variable, F.lit(0.0))
    ret = total - invested
    progress = F.greatest(F.lit(0.0), F.when(F.lit(income_goal) > 0, real_income / F.lit(float(income_goal)))
                          .otherwise(F.lit(0.0)))
    delta_text, delta_cls = T.rate_delta_label(F.col("used_rate"), F.col("official_rate"))
    return k.select(
        "portfolio_id", "total_value", "total_invested", "monthly_income",
        "funds_value", "stocks_value",
        variable.alias("variable_income_value"),
        others.alias("other_value"),
        F.when(total > 0, variable / total).otherwise(F.lit(0.0)).alias("variable_share"),
        F.when(total > 0, others / total).otherwise(F.lit(0.0)).alias("other_share"),
        "inflation",
        monthly_infl.alias("monthly_inflation"),
        upkeep.alias("upkeep"),
        real_income.alias("real_income"),
        nominal_yield.alias("nominal_yield"),
        ((1 + nominal_yield) / (1 + infl) - 1).alias("real_yield"),
        (income - real_income).alias("inflation_cost"),
        ret.alias("return_value"),
        F.when(invested > 0, ret / invested).otherwise(F.lit(0.0)).alias("return_pct"),
        T.sign_class(ret).alias("return_class"),
        progress.alias("goal_progress"),
        F.least(progress, F.lit(1.0)).alias("goal_bar"),
        "official_rate", "used_rate",
        delta_text.alias("rate_delta_text"), delta_cls.alias("rate_delta_class"),
    )


def masked_kpis(kpis: DataFrame, privacy: bool) -> DataFrame:
    """Formatted KPI strings, each of the twelve amounts masked in privacy
    mode. Not masked: the goal percentage, the reference rate and the return's
    sign, which stands before the mask."""
    money = {"total_value": "total_value_text", "total_invested": "invested_text", "monthly_income": "income_text",
             "return_value": "return_text", "upkeep": "upkeep_text", "real_income": "real_income_text",
             "inflation_cost": "inflation_cost_text", "variable_income_value": "variable_income_text",
             "other_value": "other_text"}
    shares = {"variable_share": "variable_share_text", "other_share": "other_share_text"}
    return kpis.select(
        "portfolio_id",
        *[T.masked(T.fmt_currency(F.col(c)), privacy).alias(name) for c, name in money.items()],
        *[T.masked(T.fmt_percent(F.col(c)), privacy).alias(name) for c, name in shares.items()],
        F.concat(T.sign_prefix(F.col("return_value")),
                 T.masked(T.fmt_percent(F.col("return_pct")), privacy)).alias("return_pct_text"),
        T.fmt_percent(F.col("used_rate")).alias("rate_text"),
    )


def qty_by_ticker(positions: DataFrame) -> DataFrame:
    """Summed quantity per (portfolio, ticker) over FII and stocks."""
    return (positions.where(F.col("asset_type").isin("FII", "Ação"))
            .groupBy("portfolio_id", "ticker").agg(F.sum("quantity").alias("quantity")))
