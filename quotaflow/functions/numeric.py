"""Numeric helpers shared by the operators.

Float sums depend on the order in which partitions are combined, so the same
query can give different last bits on different cluster sizes. Money totals
that feed further arithmetic (weights, targets per position) are therefore
summed as decimals with 18 fractional digits, which is independent of the
order; totals that decimals can't hold are summed as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holds amounts and totals below 1e20 currency units.
MONEY_TYPE = "decimal(38, 18)"


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf -> null (pandas ``sum``/``mean`` skip NaN)."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def exact_money_sum(c: Column) -> Column:
    """Sum of money amounts as a double, the same in any order of the rows
    (null/NaN/inf skipped, 0.0 when nothing is left). If an amount or the
    total is 1e20 or more, the plain double sum."""
    amount = finite_or_null(c.cast("double"))
    units = amount.try_cast(MONEY_TYPE)
    exact = F.when(F.count(units) == F.count(amount), F.try_sum(units).cast("double"))
    return F.coalesce(exact, F.sum(amount), F.lit(0.0))
