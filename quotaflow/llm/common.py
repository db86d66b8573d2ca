"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from quotaflow.session import scratch_path

# The white space of every contract here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WORD_WS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and
    read it back. It cuts the lineage, survives the loss of executors, and the
    size of the files lets the planner choose a broadcast only for a table
    under its threshold."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries: its cleaner acts
    only when the driver collects garbage, which a large heap puts off for long."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, and free the
    shuffle files of finished queries."""
    for df in tables:
        files = df.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if "/llm-" in folder:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    free_shuffles(tables[0].sparkSession)


def worker_cache(key: tuple, make):
    """What ``make`` returns, made once in a worker process and found again by
    its later tasks. Modules sent by value are built anew for every task, so
    their own dictionaries would not last; this one hangs on ``builtins``."""
    import builtins

    held = builtins.__dict__.setdefault("_quotaflow_worker_cache", {})
    if key not in held:
        held[key] = make()
    return held[key]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that the result is about to define."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def word_count(text: Column) -> Column:
    """Number of words, runs of characters other than WS (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_WS)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word; it must have as many."""
    parts = F.split(F.translate(text, WS, " " * len(WS)), " ", -1)  # empty between neighbouring spaces
    ends = F.filter(F.transform(parts, lambda x, i: F.when(x != "", i + 1)), lambda i: i.isNotNull())
    kept = F.slice(parts, F.lit(1), F.element_at(ends, n.cast("int")))
    return F.substring(text, F.lit(1), F.char_length(F.array_join(kept, " ")))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does that for texts of ASCII
    only; the others go through ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def crc(key: Column) -> Column:
    """crc32 of a column as text. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a column as text, modulo n."""
    return crc(key) % n


def widened(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """The schema of ``df`` with further (name, type) fields."""
    schema = StructType(list(df.schema.fields))
    for name, kind in fields:
        schema.add(name, DataType.fromDDL(kind))
    return schema
