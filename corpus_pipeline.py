"""The corpus pipeline: five stages over ``documents``, each an operator of
``quotaflow.llm`` whose decisions take effect. Each stage's rows are written as
Parquet and read again as the next one's documents, so a lost executor costs
the running stage's tasks only.

Defined results, of every stage: a document with null or empty text has no words
and is rejected by the quality rules (a later stage alone would keep it, but the
mix, which takes nothing of it); a null doc_id, lang or source is kept as it is,
null sources being one source; rows that share a doc_id are judged each on its
own text, but by near_dedup as one document; an empty table gives no rows;
further columns pass through unchanged, whatever their names, but for those that
``mixing`` adds, which replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.llm.common import first_words, written
from quotaflow.llm.decontaminate import contamination
from quotaflow.llm.jaccard_join import near_duplicates
from quotaflow.llm.line_dedup import drop_frequent_lines
from quotaflow.llm.mixing import mix_sources
from quotaflow.llm.quality import quality_bands


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def beside(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply``'s rows with the columns of ``docs``; those beyond a document's
    stand under other names meanwhile, so that none is taken for an operator's."""
    others = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    done = apply(docs.withColumnsRenamed(others))
    return done.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return beside(docs, lambda d: quality_bands(d).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go from all; n_chars follows."""
    return beside(docs, lambda d: drop_frequent_lines(d).withColumn("n_chars", F.char_length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, 0.8) the
    document with the smallest doc_id stays, with all its rows; documents
    without a word are no duplicates of each other."""
    gone = written(near_duplicates(docs, width=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return beside(docs, lambda d: contamination(d, benchmark).where("not contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix does not take go. One row stands for all takes of
    a document: ``repeats`` times its text and, where ``part_words`` is above 0,
    once ``part_text``, its first ``part_words`` words (else null). Of a
    document with repeats 0 only that part is taken: its text is cut to it, and
    n_chars follows."""
    mixed = mix_sources(docs).where("taken > 0")
    cut = F.when(F.col("part_words") > 0, first_words(F.col("text"), F.col("part_words")))
    mixed = mixed.withColumn("part_text", cut)
    mixed = mixed.withColumn("text", F.when(F.col("repeats") > 0, F.col("text")).otherwise(F.col("part_text")))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Compression ratios and seeded samples can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
