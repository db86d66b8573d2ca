"""Line dedup through a sharded minimal perfect hash.

1. Every document gives the distinct 64-bit hashes of its line keys; a count
   of documents by hash (combined before the shuffle) yields the distinct ones.
2. The distinct hashes are dealt into shards of about SHARD_KEYS. One task a
   shard builds a minimal perfect hash: levels of bit arrays; a key's place is
   the first level where it alone sets its bit, its index the rank of that bit.
   The index addresses a 32-bit fingerprint and a saturating count.
3. Documents send (hash, doc_id) probes to the arrays of their shard. A shard
   with many probes, such as one with a line that a third of the documents
   hold, is laid out several times and its probes are dealt among the copies.
4. Positive probes return to their documents, which drop those lines.

The arrays never meet a driver or a single task as a whole, and lines are never
joined with lines: 16 bytes a distinct line of a document move, not its text.

Defined results: null and empty texts are one empty line; a key shorter than
``min_chars`` (an empty one) is never dropped; every row counts as a document,
also an equal one; rows that share a doc_id, null included, are each cleaned of
the lines found too often; an empty table gives no rows; input columns with the
name of a result column are replaced.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import WS, ascii_lower, without, written

SHARD_KEYS = 200_000
PROBES = 200_000  # probes that one copy of a shard answers
GAMMA = 2.0
MOST_LEVELS = 40

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer over uint64, another one for each salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_shard(keys: np.ndarray, counts: np.ndarray, cap: int) -> dict:
    """The minimal perfect hash of distinct keys with its two arrays. Counts
    are kept up to ``cap``. Keys left after MOST_LEVELS stand in a sorted list."""
    levels, left = [], keys
    while len(left) and len(levels) < MOST_LEVELS:
        m = max(8, int(len(left) * GAMMA))
        place = (mix64(left, len(levels)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(place, minlength=m) == 1
        levels.append(alone)
        left = left[~alone[place]]
    shard = {"bits": [np.packbits(a).tobytes() for a in levels], "sizes": [len(a) for a in levels],
             "rest": np.sort(left).tobytes()}
    index = locate(shard, keys)
    prints = np.zeros(len(keys), np.uint32)
    held = np.zeros(len(keys), np.uint8 if cap < 256 else np.uint32)
    prints[index] = fingerprint(keys)
    held[index] = np.minimum(counts, cap)
    return shard | {"prints": prints.tobytes(), "counts": held.tobytes(), "wide": cap >= 256}


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 997) >> np.uint64(32)).astype(np.uint32)


def locate(shard: dict, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 for one that no level holds."""
    index, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, (bits, m) in enumerate(zip(shard["bits"], shard["sizes"])):
        if not len(open_):
            return index
        alone = np.unpackbits(np.frombuffer(bits, np.uint8), count=m)
        rank = np.cumsum(alone, dtype=np.int64)
        place = (mix64(keys[open_], level) % np.uint64(m)).astype(np.int64)
        here = alone[place] == 1
        index[open_[here]] = base + rank[place[here]] - 1
        open_, base = open_[~here], base + int(rank[-1])
    rest = np.frombuffer(shard["rest"], np.uint64)
    if len(open_) and len(rest):
        at = np.minimum(np.searchsorted(rest, keys[open_]), len(rest) - 1)
        found = rest[at] == keys[open_]
        index[open_[found]] = base + at[found]
    return index


def probe(shard: dict, keys: np.ndarray) -> np.ndarray:
    """Kept counts of the keys; 0 for a key whose fingerprint differs."""
    index = locate(shard, keys)
    prints = np.frombuffer(shard["prints"], np.uint32)
    counts = np.frombuffer(shard["counts"], np.uint32 if shard["wide"] else np.uint8)
    ok = index >= 0
    ok[ok] = prints[index[ok]] == fingerprint(keys[ok])
    out = np.zeros(len(keys), np.int64)
    out[ok] = counts[index[ok]]
    return out


INDEX_SCHEMA = ("shard long, copies int, bits array<binary>, sizes array<long>, rest binary, prints binary, "
                "counts binary, wide boolean")


def build_index(keys: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """(key, docs) to one row a shard, and the number of shards. ``copies`` is
    how often a shard is laid out."""
    keys = written(keys, "line-keys")
    n = max(1, math.ceil(keys.count() / SHARD_KEYS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        k = group["key"].to_numpy(np.int64).view(np.uint64)
        c = group["docs"].to_numpy(np.int64)
        order = np.argsort(k)  # the same arrays whatever the order of rows
        made = build_shard(k[order], c[order], min_docs)
        return pd.DataFrame([{"shard": group["shard"].iloc[0], "copies": max(1, math.ceil(c.sum() / PROBES))} | made])

    shards = keys.withColumn("shard", F.pmod(F.col("key"), F.lit(n)))
    return written(shards.groupBy("shard").applyInPandas(build, INDEX_SCHEMA), "line-index"), n


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, dropped): per document the hashes of its line keys that at
    least ``min_docs`` documents hold; documents without one are left out."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    long = F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(long, lambda k: F.xxhash64(k)))
    probes = docs.select("doc_id", F.explode(hashes).alias("key"))
    index, n = build_index(probes.groupBy("key").agg(F.count(F.lit(1)).alias("docs")), min_docs)
    # A row a shard; only the shards laid out more than once are looked up by the probes.
    hot = written(index.where("copies > 1").select("shard", F.col("copies").alias("hot_copies")), "line-hot")
    probes = probes.withColumn("shard", F.pmod(F.col("key"), F.lit(n))).join(hot, "shard", "left").select(
        "doc_id", "key", "shard",
        F.pmod(F.xxhash64("doc_id", "key"), F.coalesce("hot_copies", F.lit(1))).cast("int").alias("copy"))
    laid = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def answer(asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked[["doc_id", "key"]]
        often = probe(arrays.iloc[0].to_dict(), asked["key"].to_numpy(np.int64).view(np.uint64)) >= min_docs
        return asked.loc[often, ["doc_id", "key"]]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = probes.groupBy("shard", "copy").cogroup(laid.groupBy("shard", "copy")).applyInPandas(
        answer, f"doc_id {id_type}, key long")
    return found.groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with text less its frequent lines, n_lines (before) and
    n_dropped. A document that loses all its lines has an empty text."""
    docs = without(docs, "n_lines", "n_dropped", "_dropped", "_id", "_kept")
    found = frequent_lines(docs, min_docs, min_chars).select(F.col("doc_id").alias("_id"), F.col("dropped").alias("_dropped"))
    d = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    stays = F.filter(lines, lambda x: ~((F.char_length(line_key(x)) >= min_chars)
                                        & F.array_contains(F.col("_dropped"), F.xxhash64(line_key(x)))))
    d = d.withColumn("n_lines", F.size(lines).cast("long")).withColumn(
        "_kept", F.when(F.col("_dropped").isNull(), lines).otherwise(stays))
    return d.select(*[F.concat_ws("\n", "_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                    "n_lines", (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"))
