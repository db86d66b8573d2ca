"""Ex-dividend agenda, per portfolio.

The reference date is a parameter (the reference uses "now"). Everything is
keyed by ``portfolio_id``: the chosen month, its metrics, the per-date and
per-asset totals and the calendar grid are aggregates and joins on that key,
so no portfolio is ever gathered into one task beyond its own rows, and the
calendar has at most 31 days per portfolio.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.functions import dates as D
from quotaflow.functions import numeric as N
from quotaflow.functions import text as T

# Fixed labels (must equal the reference's).
PASSED, UPCOMING = "Já ocorreu", "Próxima"
NO_DATE = "-"
# Weekday column names, Monday first, as on the calendar grid.
WEEKDAYS_PT = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]


def _ref(reference) -> Column:
    if isinstance(reference, Column):
        return reference.cast("date")
    if isinstance(reference, _dt.datetime):
        reference = reference.date()
    return F.lit(reference).cast("date")


def build(positions: DataFrame, reference) -> DataFrame:
    """FII rows with an ex-date text other than '-', resolved against
    ``reference`` (unresolved rows dropped); dividend = monthly income
    (null -> 0); status by date <= reference; month = first day of month."""
    ref = _ref(reference)
    base = (positions.where((F.col("asset_type") == "FII") & (F.col("ex_date_text") != NO_DATE))
            .select("portfolio_id", "ticker", "ex_date_text", "link",
                    F.coalesce(F.nanvl(F.col("monthly_income"), F.lit(0.0)), F.lit(0.0)).alias("est_dividend"))
            .transform(lambda df: T.once(D.with_ex_date(df, "ex_date_text", ref, "ex_date"), "ex_date")))
    return (base.where(F.col("ex_date").isNotNull())
            .withColumn("status", F.when(F.col("ex_date") <= ref, F.lit(PASSED)).otherwise(F.lit(UPCOMING)))
            .withColumn("month", F.trunc("ex_date", "month"))
            .withColumnRenamed("link", "detail_link"))


def months(agenda: DataFrame, reference) -> DataFrame:
    """Per portfolio the ascending list of months and the default
    choice: the reference's month when present, else the earliest."""
    cur = F.trunc(_ref(reference), "month")
    return agenda.groupBy("portfolio_id").agg(
        F.array_sort(F.collect_set("month")).alias("months"),
        F.coalesce(F.max(F.when(F.col("month") == cur, F.col("month"))), F.min("month")).alias("chosen_month"),
    )


def chosen_months(agenda: DataFrame, reference, month: _dt.date | None = None) -> DataFrame:
    """(portfolio_id, chosen_month): a fixed month for every portfolio, or
    each portfolio's default (C2). Only portfolios with rows in it remain."""
    if month is None:
        return months(agenda, reference).select("portfolio_id", "chosen_month")
    return (agenda.select("portfolio_id").distinct()
            .withColumn("chosen_month", F.trunc(F.lit(month).cast("date"), "month")))


def _in_month(agenda: DataFrame, chosen: DataFrame) -> DataFrame:
    """The agenda's rows of each portfolio's chosen month: a semi-join, so that
    the agenda can't become the side that is broadcast."""
    return agenda.join(chosen, (agenda.portfolio_id == chosen.portfolio_id) & (agenda.month == chosen.chosen_month), "left_semi")


def month_slice(agenda: DataFrame, chosen: DataFrame) -> DataFrame:
    """C3 + C8: rows of the chosen month (six detail columns). Shown by date,
    then ticker; readers sort."""
    return _in_month(agenda, chosen).select(
        "portfolio_id", "ticker", "ex_date_text", "ex_date", "status", "est_dividend", "detail_link")


def metrics(agenda: DataFrame, chosen: DataFrame, reference) -> DataFrame:
    """C4: month total; already passed (date <= reference) only when the
    chosen month is the reference's month, else 0; pending = max(total -
    passed, 0)."""
    ref = _ref(reference)
    sl = _in_month(agenda, chosen).withColumnRenamed("month", "chosen_month")
    is_current = F.col("chosen_month") == F.trunc(ref, "month")
    agg = sl.groupBy("portfolio_id", "chosen_month").agg(
        N.exact_money_sum(F.col("est_dividend")).alias("month_total"),
        N.exact_money_sum(F.when(is_current & (F.col("ex_date") <= ref), F.col("est_dividend"))).alias("passed"),
    )
    return agg.withColumn("pending", F.greatest(F.col("month_total") - F.col("passed"), F.lit(0.0)))


def by_date(agenda: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dividend total per date of the chosen month."""
    sl = _in_month(agenda, chosen)
    return sl.groupBy("portfolio_id", "ex_date").agg(N.exact_money_sum(F.col("est_dividend")).alias("total"))


def by_ticker(agenda: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dividend total per asset of the chosen month. Shown largest first."""
    sl = _in_month(agenda, chosen)
    return sl.groupBy("portfolio_id", "ticker").agg(N.exact_money_sum(F.col("est_dividend")).alias("total"))


def default_month_by_date(agenda: DataFrame, reference) -> DataFrame:
    """C2 + C5 in one pass over the agenda: per (portfolio, date) totals of
    each portfolio's default month, ``(portfolio_id, chosen_month, ex_date,
    total)``. The month choice is a window over the already aggregated rows
    (at most one per date), so no second pass and no join are needed."""
    cur = F.trunc(_ref(reference), "month")
    daily = agenda.groupBy("portfolio_id", "month", "ex_date").agg(
        N.exact_money_sum(F.col("est_dividend")).alias("total"))
    w = Window.partitionBy("portfolio_id")
    pick = F.coalesce(F.max(F.when(F.col("month") == cur, F.col("month"))).over(w), F.min("month").over(w))
    return (daily.withColumn("chosen_month", pick).where(F.col("month") == F.col("chosen_month"))
            .select("portfolio_id", "chosen_month", "ex_date", "total"))


def calendar(per_date: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Weeks x Monday..Sunday grid of the chosen month per portfolio.

    A cell holds the day's total (0 when none is positive) and the text
    'day' or 'day\nR$ total'; days outside the month are null / ''.
    ``per_date`` is C5's output ``(portfolio_id, ex_date, total)``, carrying
    ``chosen_month`` itself (``default_month_by_date``) or joined to
    ``chosen``. Portfolios without events in the month get no grid, as in
    the reference.

    One shuffle: each portfolio's month is gathered into a date -> total map
    (at most 31 entries) and the week rows are generated from it with
    ``sequence``/``transform`` and ``inline``; no join, no pivot."""
    if chosen is not None:
        per_date = per_date.join(chosen, "portfolio_id")
    g = per_date.groupBy("portfolio_id", "chosen_month").agg(
        F.map_from_entries(F.collect_list(F.struct("ex_date", "total"))).alias("totals"))
    m0 = F.col("chosen_month")
    first_wd = F.weekday(m0)
    n_days = F.dayofmonth(F.last_day(m0))
    n_weeks = F.ceil((first_wd + n_days) / 7).cast("int")

    def week(w: Column) -> Column:
        fields = [w.alias("week")]
        for d, name in enumerate(WEEKDAYS_PT):
            day = (w - 1) * 7 + d - first_wd + 1
            inside = (day >= 1) & (day <= n_days)
            tot = F.try_element_at(F.col("totals"), F.date_add(m0, (day - 1).cast("int")))
            positive = F.coalesce(tot > 0, F.lit(False))
            fields.append(F.when(inside, F.when(positive, tot).otherwise(F.lit(0.0))).alias(f"{name}_value"))
            fields.append(F.when(inside, F.when(positive, F.concat(day.cast("string"), F.lit("\n"),
                                                                   T.fmt_currency(tot)))
                                 .otherwise(day.cast("string"))).otherwise(F.lit("")).alias(f"{name}_text"))
        return F.struct(*fields)

    weeks = F.transform(F.sequence(F.lit(1), n_weeks), week)
    return g.select("portfolio_id", "chosen_month", F.inline(weeks))
