"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among the sources by weight. A source may be
repeated ``max_epochs`` times at most: where its share is above that, it is
clamped and the excess goes to the others by weight, until none is above.
With sources in order of cap / weight the clamped ones are a prefix, so two
running sums over the table of sources (one row each) give the water level.

Each source is then taken ``floor(epochs)`` times whole, and the fraction that
is left by a seeded sample: documents in the order of a seeded hash until the
fraction's words are reached; the document at the cut gives its first words, as
many as are missing. The cut is found from a histogram of the hash
(4,096 bins a source), and only the rows in the bin of the cut are put in
order, so no source passes through one task. Reruns agree.

Defined results: null text counts 0 words and gives none; null
sources are one source, last in order; a source without words has target 0; an
empty table gives no rows; equal rows are separate documents; input columns
with the name of a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import without, word_count, written

BIN_BITS = 12


def weigh_in_turn(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: the given weights in turn, sources by code point, null
    last. One row a source goes through this window."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): the words of each
    source in the mix of ``share`` times all words."""
    whole = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    d = sources.withColumn("cap", F.col("source_size") * max_epochs)
    d = d.withColumn("ratio", F.col("cap") / F.col("weight"))
    d = d.withColumn("left_words", F.sum("source_size").over(whole) * F.lit(float(share))
                     - F.coalesce(F.sum("cap").over(filled), F.lit(0)))
    d = d.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    d = d.withColumn("level", F.col("left_words") / F.col("left_weight"))
    d = d.withColumn("clamped", F.col("ratio") <= F.col("level"))
    d = d.withColumn("water", F.max(F.when(~F.col("clamped"), F.col("level"))).over(whole))
    return d.select(
        "source", "source_size", "weight",
        F.when(F.col("clamped"), F.col("cap").cast("double"))
        .otherwise(F.col("water") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3,
                share: float = 1.0, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target,
    repeats (times that the mix takes the whole document), part_words (words of
    it that it takes besides) and taken (words in all)."""
    docs = without(docs, "size", "source_size", "target", "repeats", "part_words", "taken", "_h", "_bin")
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_h", key).withColumn(
        "_bin", F.shiftrightunsigned(F.col("_h"), 64 - BIN_BITS))
    bins = written(sized.groupBy("source", "_bin").agg(F.sum("size").alias("words")), "mix-bins")
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(weigh_in_turn(sizes, weights), max_epochs, share)
    plan = plan.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("whole", F.floor("epochs")).withColumn(
        "part_words", (F.col("epochs") - F.col("whole")) * F.col("source_size"))
    # The bin in which the running sum of words passes the fraction.
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
           .withColumnRenamed("source", "b_source")
           .join(plan, F.col("b_source").eqNullSafe(F.col("source")))
           .where((F.col("before") <= F.col("part_words")) & (F.col("part_words") < F.col("before") + F.col("words")))
           .select("b_source", F.col("_bin").alias("cut_bin"), (F.col("part_words") - F.col("before")).alias("cut_words")))
    # A fraction that rounding puts at the source's very end has no bin: all bins are below.
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole",
        F.coalesce("cut_bin", F.lit(1 << BIN_BITS)).alias("cut_bin"),
        F.coalesce("cut_words", F.lit(0.0)).alias("cut_words"))
    plan = written(plan, "mix-plan")  # one row a source: broadcast only if under the threshold
    d = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    order = Window.partitionBy("source").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.floor("cut_words") - F.coalesce(F.sum("size").over(order), F.lit(0))
    at_cut = d.where(F.col("_bin") == F.col("cut_bin")).withColumn("extra", F.least(F.greatest(left, F.lit(0)), F.col("size")))
    rest = d.where(F.col("_bin") != F.col("cut_bin")).withColumn(
        "extra", F.when(F.col("_bin") < F.col("cut_bin"), F.col("size")).otherwise(F.lit(0)))
    both = rest.unionByName(at_cut)
    again = (F.col("size") > 0) & (F.col("extra") == F.col("size"))
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target",
        (F.col("whole") + again.cast("long")).alias("repeats"), F.when(again, F.lit(0)).otherwise(F.col("extra")).cast("long").alias("part_words"),
        (F.col("size") * F.col("whole") + F.col("extra")).cast("long").alias("taken"))
