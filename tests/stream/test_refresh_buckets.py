"""H8's buckets and commits: a batch writes only what it touched, compaction
and replays keep the table, and nothing uncommitted is seen."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from quotaflow.session import scratch_path
from quotaflow.sources import commits as CM
from quotaflow.streaming import refresh as RS


def rows(spark, items):
    return spark.createDataFrame([(t, vp, 1.0, page) for t, vp, page in items], "ticker string, vp double, dy double, page_id long").withColumn(
        "ts", F.timestamp_add("HOUR", F.col("page_id"), F.lit("2024-01-01").cast("timestamp")))


def table(spark, out):
    return {r.ticker: r.vp for r in RS.read_latest_version(spark, out).collect()}


def folders(out, kind, batch):
    return {f for f in os.listdir(f"{out}/{kind}/batch={RS.version_id(batch)}") if f.startswith("bucket=")}


@pytest.fixture
def out(spark):
    return scratch_path(spark, f"buckets-{uuid.uuid4().hex}").removeprefix("file://")


def test_a_batch_writes_only_the_buckets_it_touches(spark, out):
    RS.apply_batch(rows(spark, [(f"T{i}", float(i), i) for i in range(100)]), 0, out)
    assert len(folders(out, RS.CHANGE, 0)) > 30
    RS.apply_batch(rows(spark, [("T5", 500.0, 200)]), 1, out)
    assert len(folders(out, RS.CHANGE, 1)) == 1
    want = {f"T{i}": float(i) for i in range(100)} | {"T5": 500.0}
    assert table(spark, out) == want
    RS.apply_batch(rows(spark, [("T5", 500.0, 200)]), 1, out)  # replayed
    assert table(spark, out) == want
    RS.apply_batch(rows(spark, []), 2, out)  # nothing changed
    assert table(spark, out) == want and folders(out, RS.CHANGE, 2) == set()


def test_compaction_bounds_the_pieces(spark, out):
    want = {}
    for batch in range(9):
        items = [(f"T{i}", batch + i / 10, 10 * batch + i) for i in range(batch % 3, 6)]
        want |= {t: vp for t, vp, _ in items}
        for _ in range(1 + batch % 2):  # odd batches are replayed
            RS.apply_batch(rows(spark, items), batch, out, buckets=4, compact_after=3)
        assert table(spark, out) == want
        pieces = RS.live_pieces(spark, out)
        assert all(sum(b == p[2] and p[0] == RS.CHANGE for p in pieces) < 3 for b in range(4))
        assert all(sum(b == p[2] and p[0] == RS.BASE for p in pieces) <= 1 for b in range(4))


def test_an_uncommitted_batch_is_not_seen(spark, out):
    assert table(spark, out) == {}
    RS.apply_batch(rows(spark, [("A", 1.0, 1)]), 0, out)
    RS._write(rows(spark, [("A", 9.0, 2), ("B", 9.0, 2)]).select("ticker", "vp", "dy", "ts", "page_id"), out, RS.CHANGE, 1, RS.BUCKETS)
    assert table(spark, out) == {"A": 1.0}
    RS.apply_batch(rows(spark, [("A", 2.0, 2)]), 1, out)
    assert table(spark, out) == {"A": 2.0}


def test_only_live_pieces_are_opened(spark, out):
    for batch in range(4):
        RS.apply_batch(rows(spark, [("A", float(batch), batch), ("B", float(batch), batch)]), batch, out, buckets=2, compact_after=3)
    opened = {f.split("/")[-3] + "/" + f.split("/")[-2] for f in RS.read_latest_version(spark, out).inputFiles()}
    assert opened == {f"batch={RS.version_id(b)}/bucket={k}" for _, b, k in RS.live_pieces(spark, out)}


def test_newest_of_commits(spark, out):
    assert CM.newest(spark, out) is None
    for version in ("002", "001"):
        CM.commit(spark, out, version, f"facts of {version}")
    assert CM.newest(spark, out) == ("002", "facts of 002")
    assert CM.newest(spark, out, before="002") == ("001", "facts of 001")
    assert CM.newest(spark, out, before="001") is None
