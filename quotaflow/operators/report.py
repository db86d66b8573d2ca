"""Morning report from the latest snapshot, per portfolio.

The context text (R2) is built per portfolio from its top 15 rows only: the
rows are ranked with a per-portfolio ``row_number`` (planned with a partial
group limit), so at most 15 lines per portfolio are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow.functions import text as T
from quotaflow.operators import screens as K

# Fixed values (must equal the reference's).
SUBJECT_PREFIX = "📊 Morning Call: "
GAIN_COLOR, LOSS_COLOR = "green", "red"
DATE_FORMAT = "dd/MM/yyyy HH:mm:ss"
# Report column -> the sheet header written by the snapshot (CSV header names).
CONTEXT_COLUMNS = [("ticker", "Ativo"), ("asset_type", "Tipo"), ("price", "Preço Atual"),
                   ("price_to_book", "P/VP"), ("dy_12m", "DY (12m)")]
TOTAL_LABELS = ("Patrimônio", "Investido", "Resultado")


def _plain_2dp(x: Column) -> Column:
    """Python '%.2f' (no grouping, half-even on the binary value)."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def _csv_field(c: Column, is_double: bool) -> Column:
    """A value as pandas writes it to CSV: doubles as Python prints them (NaN is
    empty), text quoted only when it holds a comma, quote or newline."""
    if is_double:
        return T.py_number(F.nanvl(c, F.lit(None)))
    s = c.cast("string")
    needs = s.rlike('[,"\\n\\r]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def morning_row(totals: DataFrame) -> DataFrame:
    """R1 (+ N5, N22): per portfolio value, invested, result, colour, the
    formatted amounts, the subject line and the data date."""
    value, inv = F.col("total_value"), F.col("total_invested")
    profit = value - inv
    return totals.select(
        "portfolio_id",
        value.alias("total_value"), inv.alias("total_invested"), profit.alias("profit"),
        F.when(profit >= 0, F.lit(GAIN_COLOR)).otherwise(F.lit(LOSS_COLOR)).alias("color"),
        T.fmt_currency(value).alias("value_text"),
        T.fmt_currency(inv).alias("invested_text"),
        T.fmt_currency(profit).alias("profit_text"),
        F.concat(F.lit(SUBJECT_PREFIX), T.fmt_currency(value)).alias("subject"),
        F.date_format("snapshot_ts", DATE_FORMAT).alias("data_date"),
    )


def context(positions: DataFrame, totals: DataFrame, k: int = K.REPORT_TOP) -> DataFrame:
    """R2: the top ``k`` rows by value as CSV (header + lines, value order,
    the optional columns that exist) followed by the three totals with two
    decimals. One row per portfolio: ``(portfolio_id, context)``."""
    top = K.top_by_value(positions, k)
    cols = [(c, h) for c, h in CONTEXT_COLUMNS if c in top.columns]
    header = ",".join(h for _, h in cols)
    doubles = {f.name for f in top.schema.fields if f.dataType.typeName() == "double"}
    line = F.concat_ws(",", *[F.coalesce(_csv_field(F.col(c), c in doubles), F.lit("")) for c, _ in cols])
    lines = top.groupBy("portfolio_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line")))).alias("rows"))
    csv = F.concat(F.lit(header + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    v, i = F.col("total_value"), F.col("total_invested")
    totals_text = F.concat(
        F.lit(f"{TOTAL_LABELS[0]}: R$ "), _plain_2dp(v), F.lit(f"\n{TOTAL_LABELS[1]}: R$ "), _plain_2dp(i),
        F.lit(f"\n{TOTAL_LABELS[2]}: R$ "), _plain_2dp(v - i))
    return lines.join(totals, "portfolio_id").select("portfolio_id", F.concat(csv, totals_text).alias("context"))
