"""Ex-date resolution (N11) with business-day rules.

Pure column expressions; the reference date is always a parameter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow.functions.text import strip_py

# Fixed grammar of the ex-date cell (Python strptime patterns of %d, %m, %Y, %y).
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_FULL_DATE = rf"^{_DAY}/{_MONTH}/(\d{{4}})$"
_SHORT_YEAR = rf"^{_DAY}/{_MONTH}/(\d{{2}})$"
_DAY_MONTH = r"^(\d{1,2})/(\d{1,2})$"
_NTH_BUSINESS_DAY = r"^(\d{1,2})º DIA ÚTIL"
_LAST_BUSINESS_DAY = "ÚLTIMO DIA ÚTIL"
# Two-digit years 69-99 are 19xx, 00-68 are 20xx.
_PIVOT = 69


def _as_date_col(reference) -> Column:
    if isinstance(reference, Column):
        return reference.cast("date")
    if isinstance(reference, _dt.datetime):
        reference = reference.date()
    return F.lit(reference).cast("date")


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """Exact calendar date or null (31/02 -> null, never raises)."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                       F.lpad(d.cast("string"), 2, "0"))
    return F.when((y >= 1) & (y <= 9999), text.try_cast("date"))


def nth_business_day(month_start: Column, n: Column) -> Column:
    """Month start + business-day offset (n - 1), Mon-Fri, no holidays.

    A weekend month start rolls to Monday first, so n = 1 and n = 2 both give
    the first Monday. n <= 0 -> null. Large n spills into later months.
    """
    w = F.weekday(month_start)                       # 0 = Monday
    start = F.when(w < 5, month_start).otherwise(F.date_add(month_start, (7 - w).cast("int")))
    q = F.when(w < 5, n - 1).otherwise(F.greatest(n - 2, F.lit(0)))
    ws = F.weekday(start)
    days = q + F.floor((ws + q) / 5).cast("int") * 2
    return F.when(n >= 1, F.date_add(start, days.cast("int")))


def last_business_day(month_start: Column) -> Column:
    """Last Monday-Friday of the month."""
    last = F.last_day(month_start)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)).cast("int"))


def _branches(t: Column, ref: Column) -> dict[str, Column]:
    """The five N11 grammars on stripped text ``t``; each is null when its
    grammar does not apply (or the date does not exist)."""
    up = F.upper(t)
    full = F.when(t.rlike(_FULL_DATE), _ymd(F.regexp_extract(t, _FULL_DATE, 3).cast("int"),
                                           F.regexp_extract(t, _FULL_DATE, 2).cast("int"),
                                           F.trim(F.regexp_extract(t, _FULL_DATE, 1)).cast("int")))
    yy = F.regexp_extract(t, _SHORT_YEAR, 3).cast("int")
    short = F.when(t.rlike(_SHORT_YEAR), _ymd(F.when(yy >= _PIVOT, yy + 1900).otherwise(yy + 2000),
                                              F.regexp_extract(t, _SHORT_YEAR, 2).cast("int"),
                                              F.trim(F.regexp_extract(t, _SHORT_YEAR, 1)).cast("int")))
    dd = F.regexp_extract(t, _DAY_MONTH, 1).cast("int")
    mm = F.regexp_extract(t, _DAY_MONTH, 2).cast("int")
    this_year = _ymd(F.year(ref), mm, dd)
    day_month = F.when(t.rlike(_DAY_MONTH) & this_year.isNotNull(),
                       F.when(this_year < ref, _ymd(F.year(ref) + 1, mm, dd)).otherwise(this_year))
    month_start = F.trunc(ref, "month")
    is_nth = up.rlike(_NTH_BUSINESS_DAY)
    nth = F.when(is_nth, nth_business_day(month_start, F.regexp_extract(up, _NTH_BUSINESS_DAY, 1).cast("int")))
    last = F.when(~is_nth & up.contains(_LAST_BUSINESS_DAY), last_business_day(month_start))
    return {"full": full, "short": short, "day_month": day_month, "nth": nth, "last": last}


def _combine(t: Column, b: dict[str, Column]) -> Column:
    # Grammars are tried in order; a text that fits d/m never fits the later
    # ones, so the first non-null branch is the reference's answer.
    return F.when(~(t.isNull() | (t == "") | (t == "-")),
                  F.coalesce(b["full"], b["short"], b["day_month"], b["nth"], b["last"]))


def resolve_ex_date(c: Column, reference) -> Column:
    """Ex-date text -> date relative to ``reference``.

    Order: null/''/'-' -> null; d/m/yyyy; d/m/yy; d/m (this year, next year
    when strictly before the reference, invalid -> null); 'Nº DIA ÚTIL'
    prefix; contains 'ÚLTIMO DIA ÚTIL'; else null.
    """
    ref = _as_date_col(reference)
    t = strip_py(c.cast("string"))
    return _combine(t, _branches(t, ref))


def with_ex_date(df: DataFrame, text_col: str, reference, out: str = "ex_date") -> DataFrame:
    """N11 with the text stripped once. Same result as ``resolve_ex_date``, but the
    grammars are tried in a ``transform`` over one element: outside of the
    generated row loop, which with all of them would be too large to be compiled
    to machine code, and only up to the first that fits."""
    ref = _as_date_col(reference)
    staged = df.withColumn("_xd_t", strip_py(F.col(text_col).cast("string")))
    picked = F.get(F.transform(F.array("_xd_t"), lambda t: _combine(t, _branches(t, ref))), F.lit(0))
    return staged.withColumn(out, picked).drop("_xd_t")
