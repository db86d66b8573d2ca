"""Benchmark decontamination with a positional inverted index, JVM-side only.

1. Term frequencies: the tokens of all documents, counted (combined before the
   shuffle), give the corpus frequency of each benchmark term.
2. Each window of ``width`` item words gets its two rarest terms as anchors.
3. Index: the postings (term, doc_id, position) of all anchor terms over whole
   documents, written to the shared folder.
4. Lists are intersected from the rarest term on: a posting less the term's
   offset in the item is the item's place in the document; a place where both
   anchors of a window agree is a candidate. One row an item, document and
   place, whatever the number of overlapping windows.
5. Candidates meet their documents, and the window is compared word by word.

Postings lists of common terms are never read for a window with a rarer term,
so the work follows the rare terms' frequencies. ``phrase_matches`` and
``proximity_matches`` answer exact phrase and proximity searches from a full
index (``positional_index``).

Defined results: null and empty texts have no words and are clean; an item
without words has no window; rows that share a doc_id, null included, are each
judged on their own text; an empty table of documents gives no rows, an empty
benchmark leaves all clean; input columns with the name of a result column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import ascii_lower, without, written

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of 0-9, a-z and characters beyond ASCII."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD)
    return F.filter(parts, lambda w: w != "")


def positional_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, pos) of every word of ``docs``, or of the words in
    ``terms`` (term). Positions count from 0."""
    posts = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        posts = posts.join(terms.select("term").distinct(), "term", "left_semi")
    return posts.select("term", "doc_id", "pos")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, freq) over all documents."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("freq"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) of the items that have words."""
    return items.select("item_id", words(F.col("text")).alias("terms")).where(F.size("terms") > 0)


def window_anchors(items: DataFrame, freq: DataFrame, width: int) -> DataFrame:
    """(item_id, terms, windows): windows is an array of (start, size, first,
    second), the last two being the positions in the item of the window's
    rarest terms (equal for a window of one word)."""
    placed = items.select("item_id", F.posexplode("terms").alias("p", "term"))
    rare = placed.join(freq, "term", "left").groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("p", F.coalesce("freq", F.lit(0)).alias("freq")))).alias("ranks"))
    d = items.join(rare, "item_id")
    n = F.size("terms")
    size = F.least(n, F.lit(width))

    def window(s: Column) -> Column:
        by_freq = F.array_sort(F.transform(
            F.slice("ranks", s + 1, size), lambda r: F.struct(r["freq"].alias("freq"), r["p"].alias("p"))))
        return F.struct(s.alias("start"), size.alias("size"), by_freq[0]["p"].alias("first"),
                        F.coalesce(F.get(by_freq, F.lit(1))["p"], by_freq[0]["p"]).alias("second"))

    return d.select("item_id", "terms", F.transform(F.sequence(F.lit(0), n - size), window).alias("windows"))


def candidates(index: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): the item may stand at word ``at`` of the document,
    as both anchors of one of its windows do."""
    anchor = plan.select("item_id", F.explode(F.array_distinct(F.flatten(
        F.transform("windows", lambda w: F.array(w["first"], w["second"]))))).alias("p"), "terms")
    anchor = anchor.select("item_id", "p", F.get("terms", F.col("p")).alias("term"))
    met = index.join(written(anchor, "anchors"), "term").select(
        "doc_id", "item_id", (F.col("pos") - F.col("p")).alias("at"), "p")
    met = met.groupBy("doc_id", "item_id", "at").agg(F.collect_set("p").alias("ps"))
    pairs = written(plan.select("item_id", F.transform(
        "windows", lambda w: F.array(w["first"], w["second"])).alias("pairs")), "pairs")
    return met.join(pairs, "item_id").where(F.exists(
        "pairs", lambda w: F.array_contains("ps", w[0]) & F.array_contains("ps", w[1]))).select("doc_id", "item_id", "at")


def covered(spans: Column) -> Column:
    """Words inside any of the (from, size) spans, sorted by from."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc: Column, x: Column) -> Column:
        to = x["from"].cast("long") + x["size"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), to - F.greatest(acc["end"], x["from"].cast("long")))).alias("n"),
            F.greatest(acc["end"], to).alias("end"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_hit, n_items, items_sha256
    and contaminated (``percent`` of the words at least are hit)."""
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = without(docs, *names, "_id", "_cands", "_words", "_found")
    # Items that read alike are searched once; item_of leads back to their ids.
    named = item_terms(benchmark.select("item_id", "text"))
    items = named.select(F.xxhash64("terms").alias("item_id"), "terms").dropDuplicates(["item_id"])
    ids = named.select(F.xxhash64("terms").alias("key"), F.col("item_id").cast("string").alias("id")).groupBy("key").agg(
        F.collect_set("id").alias("ids"))
    items = written(items, "items")
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    freq = written(vocabulary.join(term_frequencies(docs), "term"), "freq")
    plan = written(window_anchors(items, freq, width), "plan")
    anchor_terms = written(plan.select(F.explode("windows").alias("w"), "terms").select(
        F.explode(F.array(F.get("terms", F.col("w.first")), F.get("terms", F.col("w.second")))).alias("term")).distinct(), "anchor-terms")
    index = written(positional_index(docs, anchor_terms), "index")
    found = candidates(index, plan)
    info = written(plan.join(ids, F.col("item_id") == F.col("key")).select(
        "item_id", "terms", "ids", F.size("windows").alias("n_windows")), "info")
    cands = found.join(info, "item_id").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("at", "terms", "ids", "n_windows")).alias("_cands"))
    d = docs.join(cands, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_words", words(F.col("text")))

    def hits(c: Column) -> Column:
        size = F.least(F.size(c["terms"]), F.lit(width))
        starts = F.filter(F.sequence(F.lit(0), c["n_windows"] - 1), lambda s: (c["at"] + s >= 0) & (
            F.slice("_words", F.greatest(c["at"] + s, F.lit(0)) + 1, size) == F.slice(c["terms"], s + 1, size)))
        return F.struct(F.transform(starts, lambda s: F.struct((c["at"] + s).alias("from"), size.alias("size"))).alias("spans"),
                        c["ids"].alias("ids"))

    hit = F.filter(F.transform("_cands", hits), lambda h: F.size(h["spans"]) > 0)
    d = d.withColumn("_found", F.when(F.col("_cands").isNotNull(), hit))
    none = F.col("_found").isNull()
    spans = F.array_sort(F.flatten(F.transform("_found", lambda h: h["spans"])))
    item_ids = F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda h: h["ids"]))))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("n_hit", F.when(none, F.lit(0).cast("long")).otherwise(covered(spans)))
    d = d.withColumn("n_items", F.when(none, F.lit(0)).otherwise(F.size(item_ids)).cast("long"))
    d = d.withColumn("items_sha256", F.sha2(F.when(none, F.lit("")).otherwise(F.array_join(item_ids, ",")).cast("binary"), 256))
    d = d.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], *names)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, doc_id, pos) of every exact occurrence of (phrase_id, terms)
    in a full index. The rarest term's list leads; the other terms' lists,
    adjusted by their offsets, must all meet it."""
    freq = index.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    part = phrases.where(F.size("terms") > 0).select("phrase_id", F.size("terms").alias("n"), F.posexplode("terms").alias("p", "term"))
    rank = Window.partitionBy("phrase_id").orderBy(F.coalesce("freq", F.lit(0)), "p")
    part = written(part.join(freq, "term", "left").withColumn("rank", F.row_number().over(rank)), "phrase-parts")
    lead = index.join(part.where("rank = 1").select("phrase_id", "n", "term", "p"), "term").select(
        "phrase_id", "n", "doc_id", (F.col("pos") - F.col("p")).alias("pos"))
    rest = lead.join(part.where("rank > 1").select("phrase_id", "term", "p"), "phrase_id").select(
        "phrase_id", "n", "doc_id", F.col("pos").alias("at"), "term", (F.col("pos") + F.col("p")).alias("pos"))
    met = rest.join(index, ["doc_id", "pos", "term"]).groupBy("phrase_id", "n", "doc_id", "at").agg(
        F.count(F.lit(1)).alias("met")).where("met = n - 1").select("phrase_id", "doc_id", F.col("at").alias("pos"))
    return met.unionByName(lead.where("n = 1").select("phrase_id", "doc_id", "pos"))


def proximity_matches(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(pair_id, doc_id, pos_a, pos_b) where terms a and b of (pair_id, a, b)
    stand ``distance`` words apart at most. Positions meet by bins of that
    width, so a document's lists are not paired as a whole."""
    width = distance + 1
    a = index.join(pairs.select("pair_id", F.col("a").alias("term")), "term").select(
        "pair_id", "doc_id", F.col("pos").alias("pos_a"), F.floor(F.col("pos") / width).alias("bin"))
    b = index.join(pairs.select("pair_id", F.col("b").alias("term")), "term").select(
        "pair_id", "doc_id", F.col("pos").alias("pos_b"),
        F.explode(F.array(*[F.floor(F.col("pos") / width) + k for k in (-1, 0, 1)])).alias("bin"))
    return a.join(b, ["pair_id", "doc_id", "bin"]).where(
        (F.abs(F.col("pos_a") - F.col("pos_b")) <= distance) & (F.col("pos_a") != F.col("pos_b"))).drop("bin")
