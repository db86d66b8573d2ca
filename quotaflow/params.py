"""Screen and run parameters (K0, SURVEY 2.5; fixtures 2.4)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScreenParams:
    # Fixed default values of the screens (must equal the reference's).
    selic: float = 0.12            # reference rate used by the radar
    pvp_min: float = 0.80          # opportunity P/VP lower bound (inclusive)
    pvp_max: float = 0.99          # opportunity P/VP upper bound (inclusive)
    dy_min: float = 0.12           # opportunity minimum DY
    contribution_min: float = 1000.0
    brick_pct: float = 0.60        # radar: share of the rate for brick funds
    paper_pct: float = 0.80        # radar: share of the rate for paper funds

    def normalized(self) -> "ScreenParams":
        """P/VP max is raised to the min when it is lower."""
        if self.pvp_max < self.pvp_min:
            return ScreenParams(self.selic, self.pvp_min, self.pvp_min, self.dy_min,
                                self.contribution_min, self.brick_pct, self.paper_pct)
        return self


PREFIX = "k0_"  # columns of the parameters on position rows
OFFICIAL = PREFIX + "official_rate"


def with_params(positions: DataFrame, overrides: DataFrame, defaults: ScreenParams, official_rate: Column) -> DataFrame:
    """K0 as a relation: each position with its portfolio's parameters.

    ``overrides`` (portfolio_id and any of the parameters; one row a portfolio)
    lies over the default layer: a null, a missing column or a missing portfolio
    means the default, and of the rate the official one (the scalar that A7's
    chain gives). P/VP max is raised to the min when it is lower; an override of
    the rate that is not above 0 means the official rate."""
    names = [f.name for f in fields(ScreenParams)]
    given = [n for n in names if n in overrides.columns]
    own = overrides.select(F.col("portfolio_id"), *[F.col(n).cast("double").alias(f"_{n}") for n in given])
    joined = positions.join(own, "portfolio_id", "left")
    value = {n: F.coalesce(F.col(f"_{n}"), F.lit(getattr(defaults, n))) if n in given else F.lit(getattr(defaults, n)) for n in names}
    value["selic"] = F.coalesce(F.col("_selic"), official_rate) if "selic" in given else official_rate
    value["pvp_max"] = F.greatest(value["pvp_min"], value["pvp_max"])
    out = joined.withColumns({PREFIX + n: c for n, c in value.items()} | {OFFICIAL: official_rate})
    used = F.when(F.col(PREFIX + "selic") > 0, F.col(PREFIX + "selic")).otherwise(F.col(OFFICIAL))
    return out.withColumn(PREFIX + "selic", used).drop(*[f"_{n}" for n in given])


def columns_of(params: ScreenParams | None) -> dict[str, Column]:
    """The parameters as columns: constants, or (None) those of ``with_params``."""
    if params is None:
        return {f.name: F.col(PREFIX + f.name) for f in fields(ScreenParams)}
    p = params.normalized()
    return {f.name: F.lit(float(getattr(p, f.name))) for f in fields(ScreenParams)}


@dataclass(frozen=True)
class RunParams:
    """Everything a run depends on besides data; never ``current_date()``."""
    reference_date: _dt.date = _dt.date(2024, 6, 15)
    official_rate: float = 0.12         # rate from the source chain (A7)
    inflation_default: float = 0.045    # A6 fallback when the source fails
    income_goal: float = 10000.0        # goal of real monthly income (A5)
    privacy: bool = False
    screens: ScreenParams = field(default_factory=lambda: ScreenParams(dy_min=0.09))


# Parameters used by the registered queries (FIXTURES 2.4: dy_min 0.09).
DEFAULT_RUN = RunParams()
