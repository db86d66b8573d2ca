"""Last-known-good refresh stream.

A Structured Streaming job over a directory of page files: each micro-batch is
extracted (one parse per page, Arrow batches), misses are dropped so only
successes update, and a keyed streaming aggregation keeps the latest row per
ticker by (ts, page_id) in the state store; entries never expire.

Output is incremental. A batch writes the tickers it changed, by ticker-hash
bucket, so only the buckets it touched get a file; when a bucket has had
COMPACT_AFTER changes since its last base, its live rows become a new base in
the same batch. The batch then commits the list of live pieces, (kind, batch,
bucket), of all buckets: at most BUCKETS x (COMPACT_AFTER + 1) entries. Readers
resolve the newest commit and open those pieces only. A replayed batch writes
the same pieces under the same id and commits the same list.

State and progress live in a checkpoint under the cluster's
``spark.checkpoint.dir``, so a lost executor or a restarted query resumes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.operators.indicators import extract, indicators, latest
from quotaflow.sources import commits as CM

# Fixed value (must equal the reference's): the refresh interval.
REFRESH_INTERVAL = "6 hours"
BUCKETS = 64
COMPACT_AFTER = 8
TABLE = "ticker string, vp double, dy double, ts timestamp, page_id long"
CHANGE, BASE = "change", "base"

Piece = tuple[str, int, int]  # kind, batch, bucket


def version_id(batch_id: int) -> str:
    """Batch ids as text of one order with the numbers."""
    return f"{batch_id:012d}"


def _folder(out_dir: str, kind: str, batch_id: int) -> str:
    return f"{out_dir}/{kind}/batch={version_id(batch_id)}"


def _write(rows: DataFrame, out_dir: str, kind: str, batch_id: int, buckets: int) -> None:
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")
    (rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(_folder(out_dir, kind, batch_id)))


def _buckets(spark: SparkSession, out_dir: str, kind: str, batch_id: int) -> list[int]:
    """Buckets that a written batch has (its partition folders)."""
    found = spark.read.schema(f"{TABLE}, bucket int").parquet(_folder(out_dir, kind, batch_id))
    return sorted(r.bucket for r in found.select("bucket").distinct().collect())


def live_pieces(spark: SparkSession, out_dir: str, before: int | None = None) -> list[Piece]:
    """The pieces of the newest commit (``before``: older than that batch, as a
    replayed batch must not build on its own commit)."""
    found = CM.newest(spark, out_dir, None if before is None else version_id(before))
    return [tuple(p) for p in json.loads(found[1])] if found else []


def read_pieces(spark: SparkSession, out_dir: str, pieces: list[Piece]) -> DataFrame:
    """The latest row per ticker over the given pieces."""
    if not pieces:
        return spark.createDataFrame([], TABLE)
    paths = [f"{_folder(out_dir, kind, batch)}/bucket={bucket}" for kind, batch, bucket in pieces]
    return latest(spark.read.schema(TABLE).parquet(*paths))


def apply_batch(changes: DataFrame, batch_id: int, out_dir: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER) -> None:
    """Write one micro-batch's changed tickers, compact the buckets that are due
    and commit the list of live pieces."""
    spark = changes.sparkSession
    _write(changes.select("ticker", "vp", "dy", "ts", "page_id"), out_dir, CHANGE, batch_id, buckets)
    pieces = live_pieces(spark, out_dir, before=batch_id)
    pieces += [(CHANGE, batch_id, b) for b in _buckets(spark, out_dir, CHANGE, batch_id)]
    held: dict[int, int] = {}
    for kind, _, b in pieces:
        held[b] = held.get(b, 0) + (kind == CHANGE)
    due = {b for b, n in held.items() if n >= compact_after}
    if due:
        _write(read_pieces(spark, out_dir, [p for p in pieces if p[2] in due]), out_dir, BASE, batch_id, buckets)
        pieces = [p for p in pieces if p[2] not in due] + [(BASE, batch_id, b) for b in sorted(due)]
    CM.commit(spark, out_dir, version_id(batch_id), json.dumps(pieces))


def refresh_stream(spark: SparkSession, page_dir: str, page_schema: str, out_dir: str, checkpoint: str,
                   available_now: bool = True, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
    """H8 as a Structured Streaming job over a directory of page files."""
    stream = spark.readStream.schema(page_schema).parquet(page_dir)
    keyed = latest(indicators(extract(stream)))
    root = out_dir.rstrip("/")
    writer = (keyed.writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch_id: apply_batch(df, batch_id, root, buckets, compact_after)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=REFRESH_INTERVAL)
    return writer.start()


def read_latest_version(spark: SparkSession, out_dir: str) -> DataFrame:
    """The keyed table as of the newest commit."""
    root = out_dir.rstrip("/")
    return read_pieces(spark, root, live_pieces(spark, root))
