"""Commits of snapshots."""

import datetime
import uuid

import pytest

from quotaflow.session import scratch_path
from quotaflow.sources import sheets as SH

TS = datetime.datetime(2024, 6, 15, 8, 0)


def inputs(spark, value):
    pos = spark.createDataFrame([(1, "A", "FII", 1.0, value, 1.0, 0.1, "x")],
                                "portfolio_id long, ticker string, asset_type string, price double, market_value double, "
                                "price_to_book double, dy_12m double, sector string")
    return pos, spark.createDataFrame([(1, value, 1.0)], "portfolio_id long, total_value double, total_invested double")


def test_reader_scans_the_committed_partition_only(spark):
    path = scratch_path(spark, f"snap-{uuid.uuid4().hex}")
    with pytest.raises(FileNotFoundError):
        SH.read_latest_snapshot(spark, path)
    for day in range(3):
        SH.write_snapshot(*inputs(spark, 10.0 + day), path, TS + datetime.timedelta(days=day))
    totals, positions = SH.read_latest_snapshot(spark, path)
    assert totals.first().total_value == positions.first().market_value == 12.0
    for df in (totals, positions):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "20240617080000" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_snapshot_without_its_commit_is_not_seen(spark):
    path = scratch_path(spark, f"snap-{uuid.uuid4().hex}")
    SH.write_snapshot(*inputs(spark, 10.0), path, TS)
    pos, kpis = inputs(spark, 99.0)
    # the writer of a later snapshot dies between its data and its commit
    pos.selectExpr("*", "timestamp'2024-07-01' snapshot_ts", "'20240701000000' snapshot_id").write.mode(
        "append").partitionBy("snapshot_id").parquet(f"{path}/positions")
    kpis.selectExpr("*", "timestamp'2024-07-01' snapshot_ts", "'20240701000000' snapshot_id").write.mode("append").partitionBy(
        "snapshot_id").parquet(f"{path}/totals")
    totals, positions = SH.read_latest_snapshot(spark, path)
    assert totals.first().total_value == positions.first().market_value == 10.0
