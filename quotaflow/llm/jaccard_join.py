"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Two link when their
Jaccard similarity is ``percent`` or more, so at sizes a and b their symmetric
difference is at most d = (a + b) (100 - p) / (100 + p).

Sketch: every shingle toggles one bit of a wide bit vector (parity), so the
Hamming distance of two sketches is at most the symmetric difference. The
vector is cut into k blocks by shingle; documents of one size band (a power of
two) share k, which is a fourth above the greatest difference of linked sets.
A linked pair with d differences then agrees on k - d blocks at least
(pigeonhole), so among the d + 1 blocks that stand first in one fixed order
each has one in common with the other. Blocks of many shingles come first in
it, as poor ones say little. A document sends d + 1 blocks, d being its
greatest difference with any partner, and a block is known by an XOR of random
words, one for each bit that is set.

Join: equal sets are first one class. Blocks that two classes share name a
bucket; its hub is the member met most in all buckets (ties: the least id).
Every member is verified against the hub only, on whole texts, so a bucket of
n members costs n verifications, not n squared.

Before that, members without a partner go: a short sketch of a set (parities of
its shingles, one or two bits a shingle) differs from a linked set's by d bits at
most. The sketches of all members of a hub are compared in one task, and each
component of those that may link is verified against a hub of its own. Passages
that many texts hold thus bring together no texts that differ otherwise. A hub
with more than GROUP members keeps them all.

Pairs of members that don't both link with the hub are found from their
differences to the hub, D(x) = set of x and hub's, in one or the other:
|D(x) & D(y)| >= (|D(x)| + |D(y)| - d) / 2 for a linked pair. That is an overlap
of small sets, joined by their prefixes (elements of cells that few
differences hold come first). The differences also tell the pair's exact similarity.
First each member meets one other for each element; then those that are still
in different components meet all. No link that joins components is lost, and
no group's pairs are written out.

Components are the labels of repeated minimum over links with pointer jumping;
classes get their smallest doc_id.

Defined results: null and empty texts have an empty set, linked with nothing;
a null doc_id has no links and a null component; of rows that share a doc_id
the greatest text (by bytes) is the document, n_shingles is each row's own; an
empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import discard, free_shuffles, written

BITS = 4096  # bits a block
SPARE = 4  # a fourth more blocks than differences
HOT = 200  # members of a bucket whose hub is found by an aggregate and a join
WORDS = 200_000  # words whose hashes a worker remembers
ROWS = 512  # texts in each batch that a worker returns
CELL_BITS = 16  # cells in which elements of differences are counted
SKETCH = 8192  # greatest number of bits in a set's short sketch
GROUP = 4096  # members of a hub whose sketches are all compared

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
LOWERED = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct 64-bit shingle hashes of texts; word hashes are remembered."""

    def __init__(self, width: int) -> None:
        import xxhash

        self.width, self.hash, self.seen = width, xxhash.xxh64_intdigest, {}

    def shingles(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWERED).split()
        if not words:
            return np.zeros(0, U)
        seen = self.seen
        if len(seen) > WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.hash(w)
        h = np.array([seen[w] for w in words], U)
        width = min(self.width, len(words))
        total = np.full(len(h) - width + 1, U(width))
        for i in range(width):
            total = mix(total * U(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
        return np.unique(total)


def block_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the blocks that a set of shingles sends: those of its own band
    and, if it may link with a larger set there, of the next band."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U)
    scale, loss, largest = 100 + percent, 100 - percent, n * 100 // percent
    keys = []
    for band in range(n.bit_length(), largest.bit_length() + 1):
        end = (1 << band) - 1  # the band's greatest size
        most = 2 * end * loss // scale  # difference of linked sets in this band
        own = (n + min(end, largest)) * loss // scale  # and of this one with any
        k = most + 1 + 1 + most // SPARE
        block = ((hashes >> U(32)) * U(k) >> U(32)).astype(np.int64)
        bit = mix((hashes & U(BITS - 1)) + block.astype(U) * U(BITS) + U(1))
        order = np.argsort(block, kind="stable")
        held = np.bincount(block, minlength=k)
        words = np.zeros(k, U)
        words[held > 0] = np.bitwise_xor.reduceat(bit[order], np.flatnonzero(np.r_[True, np.diff(block[order]) > 0]))
        tag = (U(band) << U(52)) + (np.arange(k, dtype=U) << U(26)) + held.astype(U)
        found = mix(words + mix(tag + U(7)))
        keys.append(found[np.lexsort((found, -held))[:own + 1]])
    return np.concatenate(keys)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles: the least power of two of bits above their
    number (64 to SKETCH), in words of 64."""
    bits = min(SKETCH, max(64, 1 << len(hashes).bit_length()))
    at = (hashes >> U(16)) & U(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U)


def may_link(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix: whether two sets may link, as far as their sizes and sketches tell.
    A sketch of more words is folded to the width of the other."""
    widths = np.array([len(x) for x in sketches])
    found = np.zeros((len(sizes), len(sizes)), bool)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        own = np.stack([sketches[i] for i in rows])
        for v in np.unique(widths[widths >= w]):
            cols = np.flatnonzero(widths == v)
            folded = np.bitwise_xor.reduce(np.stack([sketches[i] for i in cols]).reshape(len(cols), v // w, w), axis=1)
            step = max(1, (1 << 20) // (len(cols) * int(w)))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                apart = np.bitwise_count(own[at:at + step, None] ^ folded[None]).sum(axis=2, dtype=np.int64)
                a, b = sizes[part, None], sizes[None, cols]
                near = np.maximum(apart, abs(a - b)) <= (a + b) * (100 - percent) // (100 + percent)
                found[np.ix_(part, cols)] = near
                found[np.ix_(cols, part)] = near.T
    return found


def _partners(percent: int):
    """Rows (hub, doc, n, sketch) in order of hub, the hub's own among them: one
    row (hub, doc) for each member but the hub of a component of those that may
    link. The group's hub is that of its own component, elsewhere the member
    with the most partners (ties: the least id)."""

    def split(group: pa.Table):
        hub, docs = group["hub"][0].as_py(), group["doc"].to_numpy()
        near = may_link(group["n"].to_numpy(), [np.frombuffer(x, U) for x in group["sketch"].to_pylist()], percent)
        np.fill_diagonal(near, False)
        met = near.sum(axis=1)
        left = met > 0
        for first in np.lexsort((docs, -met, docs != hub)):
            if not left[first]:
                continue
            member, edge = np.zeros(len(docs), bool), np.array([first])
            member[first] = True
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & ~member)
                member[edge] = True
            left &= ~member
            member[first] = False
            yield docs[first], docs[member]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            ends = np.flatnonzero(np.diff(rest["hub"].to_numpy())) + 1
            if len(ends):
                yield from answer(rest, [0, *ends])
                rest = rest.slice(ends[-1])
        if rest is not None and rest.num_rows:
            yield from answer(rest, [0, rest.num_rows])

    def answer(table, ends):
        found = [x for at, end in zip(ends, ends[1:]) for x in split(table.slice(at, end - at))]
        if found:
            hubs = np.repeat([hub for hub, _ in found], [len(docs) for _, docs in found])
            yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(np.concatenate([docs for _, docs in found]))], ["hub", "doc"])

    return run


def partners(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the (hub, doc) pairs those that are to be verified, by the sketches in
    ``sets`` (doc_id, n_shingles, sketch)."""
    sizes = written(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("members")), "groups")
    pairs = pairs.join(sizes, "hub")
    small, hubs = pairs.where(F.col("members") < GROUP), sizes.where(F.col("members") < GROUP)
    rows = small.select("hub", "doc").unionByName(hubs.select("hub", F.col("hub").alias("doc")))
    rows = rows.join(sets, F.col("doc") == F.col("doc_id")).select("hub", "doc", F.col("n_shingles").alias("n"), "sketch")
    found = rows.repartition("hub").sortWithinPartitions("hub", "doc").mapInArrow(_partners(percent), "hub long, doc long")
    large = pairs.where(F.col("members") >= GROUP).select("hub", "doc")
    done = written(found.unionByName(large).distinct(), "partners")
    discard(sizes)
    return done


def _sets(width: int, percent: int):
    def run(batches):
        shingler = Shingler(width)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sizes, sums, xors, short, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingler.shingles(text)
                sizes.append(len(h))
                sums.append(int(h.sum(dtype=U).view(np.int64)))
                xors.append(int(np.bitwise_xor.reduce(mix(h)).view(np.int64)))
                short.append(sketch(h).tobytes())
                keys.append(np.unique(block_keys(h, percent)).view(np.int64))
            lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(lengths, np.concatenate([*keys, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()),
                 pa.array(short, pa.binary()), listed],
                ["doc_id", "n_shingles", "sig1", "sig2", "sketch", "keys"])

    return run


def _verify(width: int, percent: int):
    """Rows (hub, doc, is_hub, text) in order of hub, the hub's own row first:
    one row out a pair, with its sizes, whether it links, its difference to
    the hub, and the lengths of the prefixes that its order will have."""

    def run(batches):
        shingler = Shingler(width)
        hub, base = None, None
        for pdf in batches:
            rows = []
            for h, doc, own, text in zip(pdf["hub"], pdf["doc"], pdf["is_hub"], pdf["text"]):
                mine = shingler.shingles(text)
                if own:
                    hub, base = h, mine
                    continue
                if hub != h:
                    raise RuntimeError(f"hub {h} has no row of its own")
                added = np.setdiff1d(mine, base, assume_unique=True)
                gone = np.setdiff1d(base, mine, assume_unique=True)
                m, s, sh = len(added) + len(gone), len(mine), len(base)
                both = s - len(added)
                links = 100 * both >= percent * (s + len(gone))
                scale, loss = 100 + percent, 100 - percent
                # Least overlap with a partner of which one or both don't link with the hub ...
                half = (scale * m + loss * (sh - s)) // (2 * scale) + 1
                # ... and, for one that doesn't, with any partner.
                far = max(1, m - s * (100 - percent) // percent)
                short = max(0, m - half + 1) if m >= half else 0
                long = 0 if links else max(0, m - far + 1)
                short = min(short, long) if not links else short
                rows.append((h, doc, s, sh, links, short, long, np.concatenate([added, gone]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["hub", "doc", "n", "n_hub", "links", "short", "long", "delta"])

    return run


def verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verify (hub, doc) pairs on the whole texts (doc_id, text). A hub with
    many members is laid out several times and its members dealt among them."""
    load = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(200)).cast("int").alias("copies"))
    hubs = load.select("hub", F.col("hub").alias("doc"), F.lit(True).alias("is_hub"),
                       F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    members = pairs.join(load, "hub").select(
        "hub", "doc", F.lit(False).alias("is_hub"), F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int").alias("copy"))
    # Written, its size is known: while it is small the texts are not shuffled to meet it.
    wanted = written(hubs.unionByName(members), "wanted")
    sent = texts.join(wanted, F.col("doc_id") == F.col("doc")).select("hub", "copy", "doc", "is_hub", "text")
    sent = sent.repartition("hub", "copy").sortWithinPartitions("hub", "copy", F.desc("is_hub"), "doc")
    found = written(sent.select("hub", "doc", "is_hub", "text").mapInPandas(
        _verify(width, percent),
        "hub long, doc long, n long, n_hub long, links boolean, short int, long int, delta array<long>"), "verified")
    discard(wanted)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over (a, b) links, for every
    node of a link. Minimum over neighbours, then pointer jumping, until no
    label changes; one checkpointed table of labels a round."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        done = written(step.join(up, F.col("label") == F.col("up"), "left").select(
            "node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label")), "labels")
        settled = done.where("old <> label").isEmpty()
        discard(labels)
        if settled:
            discard(edges)
            return done.select("node", F.col("label").alias("component"))
        labels = done.select("node", "label")


def bucket_pairs(reps: DataFrame) -> DataFrame:
    """(hub, doc) of all buckets of ``reps`` (doc_id, keys): every member but
    the hub with it. A bucket of up to HOT members is ordered by one window; the
    hubs of larger ones come from an aggregate that is joined back, which Spark
    can split, so no bucket is one task's work."""
    blocks = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    shared = written(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    free_shuffles(reps.sparkSession)  # of the counts
    met = F.sum("n").over(Window.partitionBy("rep"))  # a document's own blocks
    ranked = written(blocks.join(shared, "key").select("key", "rep", "n", met.alias("met")), "ranked")
    discard(shared)
    best = Window.partitionBy("key").orderBy(F.desc("met"), "rep")
    small = ranked.where(F.col("n") <= HOT).select("rep", F.first("rep").over(best).alias("hub"))
    large = ranked.where(F.col("n") > HOT)
    hubs = large.groupBy("key").agg((-F.max(F.struct("met", (-F.col("rep")).alias("order")))["order"]).alias("hub"))
    found = small.unionByName(large.join(hubs, "key").select("rep", "hub"))
    pairs = written(found.where("hub <> rep").select("hub", F.col("rep").alias("doc")).distinct(), "pairs")
    discard(ranked)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each of ``docs``
    (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n_shingles long, sig1 long, sig2 long, sketch binary, keys array<long>"
    sets = written(texts.mapInArrow(_sets(width, percent), schema), "sets")
    sizes = written(sets.drop("keys"), "sizes")
    rows, named = sizes.select("doc_id", "n_shingles"), texts.where("doc_id is not null")
    twice = written(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.isEmpty():  # the greatest text stands for the document
        one = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        named = named.join(twice, "doc_id", "left_anti").unionByName(one)
        discard(sets)
        sets = written(named.mapInArrow(_sets(width, percent), schema), "sets")
        sizes = written(sets.drop("keys"), "sizes")
    filled = "doc_id is not null and n_shingles > 0"
    nodes = sizes.where(filled)
    # Equal sets: one class, known by its smallest doc_id.
    sig = ["n_shingles", "sig1", "sig2"]
    classes = written(nodes.groupBy(*sig).agg(F.min("doc_id").alias("rep")), "classes")
    reps = sets.where(filled).join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    # Written, as it is read twice and its exchange is the size of the blocks.
    reps = written(reps.select("doc_id", "keys"), "reps")
    discard(sets)
    met = bucket_pairs(reps)
    discard(reps)  # the blocks, the greater part of all that is written
    pairs = partners(met, nodes, percent)
    discard(met)
    first = verified(named, pairs, width, percent)
    discard(pairs)
    links = first.where("links").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    links, every = written(links, "links"), first
    first = rarest_first(every)
    discard(every)
    for nearest in (True, False):
        labels = components(links)
        met = crossed(first, labels, nearest, percent)
        more = written(links.unionByName(related(met, first, percent)), "links")
        discard(links, labels, met)
        links = more
    found = components(links)
    discard(first, links)
    classed = nodes.select("doc_id", *sig).join(classes, sig).select(F.col("doc_id").alias("id"), "rep")
    of_doc = classed.join(found, F.col("rep") == F.col("node"), "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    return rows.join(of_doc, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _cells(delta: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all rows, one after the other, and their cells."""
    elements = delta.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    return elements, (elements >> U(64 - CELL_BITS)).astype(np.int64)


def _count_cells(batches):
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_cells(batch.column("delta"))[1], minlength=len(total))
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["cell", "n"])


def _in_order(counts):
    def run(batches):
        for batch in batches:
            delta = batch.column("delta")
            elements, cells = _cells(delta)
            sizes = delta.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((elements, counts.value[cells], np.repeat(np.arange(len(sizes)), sizes)))
            ordered = pa.ListArray.from_arrays(
                np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(elements[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ordered if name == "delta" else batch.column(name) for name in batch.schema.names], batch.schema.names)

    return run


def rarest_first(first: DataFrame) -> DataFrame:
    """The members of the hubs that not all of them link with, each difference
    in one order of all elements: rare ones first, by how often the element's
    cell (one of 2^CELL_BITS, by hash) occurs in the differences. Any one order
    finds the same links; the counts are a table of fixed size."""
    open_hubs = written(first.where("not links").select("hub").distinct(), "open")
    counts = np.zeros(1 << CELL_BITS, np.int64)
    found = first.select("delta").mapInArrow(_count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[found["cell"]] = found["n"]
    d = first.join(open_hubs, "hub", "left_semi")
    return written(d.mapInArrow(_in_order(d.sparkSession.sparkContext.broadcast(counts)), d.schema), "ordered")


def crossed(first: DataFrame, found: DataFrame, nearest: bool, percent: int) -> DataFrame:
    """(hub, x, y) pairs still to compare: members of one hub of which x at
    least doesn't link with it, that are in different components so far and
    whose differences to the hub share an element of their prefixes. If
    ``nearest``, x meets one member for each element, the one nearest the hub.

    Of two members in different components one is outside the hub's, and doesn't
    link with it: that one is x. (Where no member links, a member's component
    stands for the hub's.)"""
    d = first.join(found, F.col("doc") == F.col("node"), "left").select(
        "hub", "doc", "n", "links", "short", "long", "delta", F.coalesce("component", "doc").alias("part"))
    every = d.where("short > 0").select(
        "hub", F.size("delta").alias("m"), "doc", "part", "links", "n", F.posexplode(F.slice("delta", F.lit(1), F.col("short"))).alias("j", "element"))
    main = d.groupBy("hub").agg(F.coalesce(F.min(F.when(F.col("links"), F.col("part"))), F.min("part")).alias("main"))
    far = d.where("not links").join(main, "hub").where(F.col("part") != F.col("main")).select(
        "hub", F.col("doc").alias("x"), F.col("part").alias("x_part"), F.col("n").alias("x_n"), F.size("delta").alias("x_m"), "short",
        F.posexplode(F.slice("delta", F.lit(1), F.col("long"))).alias("i", "element"))
    if nearest:
        every = every.groupBy("hub", "element").agg(F.min(F.struct("m", "doc", "part", "links", "n", "j")).alias("y")).select(
            "hub", "element", "y.*")
    # After the first shared element the overlap is what is left of the shorter rest at most.
    apart = ((far["x_n"] + every["n"]) * (100 - percent) / (100 + percent)).cast("long")
    most = F.least(far["x_m"] - far["i"], every["m"] - every["j"])
    met = far.join(every, (far["hub"] == every["hub"]) & (far["element"] == every["element"]) & (far["x_part"] != every["part"])
                   & (every["links"] | (far["i"] < far["short"])) & (2 * most >= far["x_m"] + every["m"] - apart))
    return written(met.groupBy("x", F.col("doc").alias("y")).agg(F.min(far["hub"]).alias("hub")), "crossed")


def related(pairs: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the (hub, x, y) pairs that link, by their differences to the hub:
    the elements in one difference only are those in one of x and y only."""
    side = first.select("hub", "doc", "n", "delta")
    x, y = (side.select("hub", F.col("doc").alias(k), F.col("n").alias(f"n_{k}"), F.col("delta").alias(f"delta_{k}")) for k in "xy")
    d = pairs.join(x, ["hub", "x"]).join(y, ["hub", "y"])
    apart = F.size("delta_x") + F.size("delta_y") - 2 * F.size(F.array_intersect("delta_x", "delta_y"))
    total = F.col("n_x") + F.col("n_y")
    # Twice the intersection is total - apart, twice the union total + apart.
    return d.where(100 * (total - apart) >= percent * (total + apart)).select(F.col("x").alias("a"), F.col("y").alias("b"))


