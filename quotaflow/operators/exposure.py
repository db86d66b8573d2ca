"""Sector exposure and the type -> sector -> asset hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_sector(positions: DataFrame) -> DataFrame:
    """Value per (portfolio, sector). Shown largest first; readers sort."""
    return positions.groupBy("portfolio_id", "sector").agg(F.sum("market_value").alias("sector_value"))


def hierarchy(positions: DataFrame) -> DataFrame:
    """Totals at every level of type -> sector -> asset per portfolio
    (the sunburst's data). ``level`` 0 = portfolio, 1 = type, 2 = sector,
    3 = asset. Explicit grouping sets, each keyed by the portfolio: rows are
    expanded four times (not five as a rollup would, whose grand total across
    portfolios is not wanted) and aggregated partially before the shuffle."""
    keys = ["portfolio_id", "asset_type", "sector", "ticker"]
    sets = [keys[:4], keys[:3], keys[:2], keys[:1]]
    g = (positions.groupingSets(sets, *keys)
         .agg(F.sum("market_value").alias("node_value"),
              F.count(F.lit(1)).alias("n_positions"),
              F.grouping_id().alias("_gid")))
    level = (F.when(F.col("_gid") == 0, 3).when(F.col("_gid") == 1, 2)
             .when(F.col("_gid") == 3, 1).otherwise(0)).cast("int")
    return g.select("portfolio_id", level.alias("level"), "asset_type", "sector", "ticker",
                    "node_value", "n_positions")
