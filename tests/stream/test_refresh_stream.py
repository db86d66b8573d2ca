"""H8: the refresh stream over split page files equals the batch twin."""

import uuid

from pyspark.sql import functions as F

from quotaflow.operators import indicators as H
from quotaflow.streaming import refresh as RS
from quotaflow.session import scratch_path
from quotaflow.sources import fixtures as FX

SCHEMA = "page_id long, ticker string, url string, final_url string, status int, ts timestamp, html string"


def test_stream_matches_batch(spark, sf_small):
    run = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    pages = FX.refresh_pages(spark, sf_small)
    # Several files, as pages arrive over refresh rounds.
    pages.repartition(5, F.col("page_id") % 5).write.parquet(f"{run}/pages")
    q = RS.refresh_stream(spark, f"{run}/pages", SCHEMA, f"{run}/latest", f"{run}/checkpoint")
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r.ticker: (r.vp, r.dy, r.page_id) for r in RS.read_latest_version(spark, f"{run}/latest").collect()}
    want = {r.ticker: (r.vp, r.dy, r.page_id)
            for r in H.latest(H.indicators(H.extract(FX.refresh_pages(spark, sf_small)))).collect()}
    assert got == want and len(got) > 0
    # A replay of the same query (same checkpoint) finds nothing new and keeps the table.
    q2 = RS.refresh_stream(spark, f"{run}/pages", SCHEMA, f"{run}/latest", f"{run}/checkpoint")
    q2.awaitTermination(300)
    again = {r.ticker: (r.vp, r.dy, r.page_id) for r in RS.read_latest_version(spark, f"{run}/latest").collect()}
    assert again == want
