"""Scoring by an n-gram model with deleted interpolation.

    p(w | v) = a2(b) c(v w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1)

with counts over all training documents and b the bucket of the context's
frequency c(v) (powers of two). The weights come from expectation-maximisation
on held-out counts: every training token is left out in turn, its own
occurrence taken off c(v w), c(v), c(w) and N ("deleted").

Words and pairs are counted without a dictionary that all tasks hold:

1. Documents are coded into blocks of about BLOCK_TOKENS tokens: the block's
   distinct word hashes and its token stream as numbers into them.
2. Each block sends its distinct keys (words, then pairs of words) with their
   training counts, cut by key range, to the range's task, which adds up over
   blocks and answers each block its keys' totals. Counts are combined before
   the shuffle, so a very common word is one key a block.
3. A block meets its answers and has the counts of every token.

All statistics cover all training documents and grow with them. What reaches
the driver is the table of the EM's cells, bounded by its bins.

Defined results: null and empty texts are one end token; a null doc_id counts
as empty text for its fold; equal rows count and are scored each; an empty
table gives no rows; without training tokens the model is uniform; further
columns of the input are not read.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import crc_mod, written

BLOCK_TOKENS = 1_000_000
RANGE_KEYS = 500_000  # keys of all blocks that one task adds up
EM_ROUNDS = 60
BINS = 4  # bins a power of two

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
LOWERED = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = b" "  # no word


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, by significance, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch, one at a time: a block is large."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


CODED = ("block long, n_tokens long, n_words long, doc_ids array<long>, held array<boolean>, lengths binary, "
         "words binary, stream binary")


def _code(batches):
    """(doc_id, text, held) to blocks. A block's number is the task's partition
    and a count, so another attempt of the task makes the same blocks."""
    import xxhash
    from collections import defaultdict

    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    ids, held, lengths, stream, size, vocab = [], [], [], [], 0, None

    def block():
        words = np.array([xxhash.xxh64_intdigest(w) for w in vocab], U)
        cols = [pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([len(words)], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                pa.array([squeeze(np.array(lengths, np.uint32))]), pa.array([squeeze(words)]),
                pa.array([squeeze(np.concatenate(stream))])]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in CODED.split(", ")])

    for batch in batches:
        for i, text, out in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held"))):
            if vocab is None:
                vocab = defaultdict()
                vocab.default_factory = vocab.__len__
                vocab[END]
            words = (text or b"").translate(LOWERED).split()
            words.append(END)
            stream.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
            ids.append(i)
            held.append(out)
            lengths.append(len(words))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield block()
                number += 1
                ids, held, lengths, stream, size, vocab = [], [], [], [], 0, None
    if ids:
        yield block()


class Block:
    """A coded block: words (hashes), w (token numbers), v (numbers of the words
    before them, the end token first), train (token by token)."""

    def __init__(self, row: dict) -> None:
        self.words = unsqueeze(row["words"], np.uint64)
        self.w = unsqueeze(row["stream"], np.uint32).astype(np.int64)
        self.lengths = unsqueeze(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.v = np.r_[0, self.w[:-1]]  # 0 is the end token, which also ends the document before
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)

    def word_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, their training counts, and each token's key."""
        order = np.argsort(self.words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = place[self.w]
        return self.words[order], np.bincount(at[self.train], minlength=len(order)), at

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = mix(self.words[self.v] * U(0x9E3779B97F4A7C15) + mix(self.words[self.w]))
        keys, at = np.unique(key, return_inverse=True)
        return keys, np.bincount(at[self.train], minlength=len(keys)), at


def _send(kind: str, ranges: int):
    """Blocks to (range, block, keys, counts): sorted keys cut by range."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row)
                keys, counts, _ = b.word_keys() if kind == "words" else b.pair_keys()
                part = ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                found = [(r, row["block"], squeeze(np.diff(keys[i:j], prepend=U(0))), squeeze(counts[i:j].astype(np.uint32)))
                         for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                     pa.array(cols[3], pa.binary())], ["range", "block", "keys", "counts"])

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    """Totals over the blocks of one range, an answer for each block. The
    number of keys met in training and their sum stand in the first row."""
    keys = [np.cumsum(unsqueeze(k, np.uint64), dtype=U) for k in group["keys"]]
    counts = np.concatenate([unsqueeze(c, np.uint32) for c in group["counts"]])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.uint64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    answers = [squeeze(a) for a in np.split(total[at], cuts)]
    first = np.arange(len(group)) == 0
    return pd.DataFrame({"range": group["range"], "block": group["block"], "answer": answers,
                         "n_seen": np.where(first, int((total > 0).sum()), 0), "n_all": np.where(first, int(total.sum()), 0)})


def totals(coded: DataFrame, kind: str, n_keys: int) -> DataFrame:
    """(range, block, answer, n_seen, n_all) for all keys of a kind."""
    ranges = max(1, math.ceil(n_keys / RANGE_KEYS))
    sent = coded.mapInArrow(_send(kind, ranges), "range long, block long, keys binary, counts binary")
    return written(sent.groupBy("range").applyInPandas(
        _add, "range long, block long, answer binary, n_seen long, n_all long"), kind)


def _counts(row: dict) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """The block with c(v w), c(v) and c(w) of every token."""
    b = Block(row)
    got = {k: np.concatenate([unsqueeze(a["answer"], np.uint64) for a in sorted(row[k], key=lambda a: a["range"])])
           for k in ("word_totals", "pair_totals")}
    keys, _, at = b.word_keys()
    by_word = got["word_totals"][at].astype(np.float64)
    of_number = np.zeros(len(keys))
    of_number[b.w] = by_word
    return b, got["pair_totals"][b.pair_keys()[2]].astype(np.float64), of_number[b.v], by_word


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(context + 1)).astype(np.int64)


def shares(pair, context, word, n) -> tuple[np.ndarray, np.ndarray]:
    """The maximum-likelihood estimates from the pair and from the word."""
    return np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / n if n > 0 else np.zeros_like(word)


def _cells(n: int):
    """Left-out training tokens by bucket and binned estimates."""

    def bins(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.floor(-np.log2(np.maximum(p, 1e-300)) * BINS), 0).astype(np.int64)

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                b, pair, context, word = _counts(row)
                t = b.train
                p2, p1 = shares(pair[t] - 1, context[t] - 1, word[t] - 1, n - 1)
                cell = np.stack([bucket_of(context[t] - 1), bins(p2), bins(p1)])
                flat = np.ravel_multi_index(cell, (64, 4096, 4096)) if t.any() else np.zeros(0, np.int64)
                keys, at = np.unique(flat, return_inverse=True)
                sums = [np.bincount(at, weights=x, minlength=len(keys)) for x in (np.ones(len(at)), p2, p1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), *[pa.array(s, pa.float64()) for s in sums]], ["cell", "n", "p2", "p1"])

    return run


def learn_weights(cells: pd.DataFrame, v: int) -> np.ndarray:
    """Weights (64 buckets, 3) of pair, word and uniform estimate by EM."""
    a = np.tile([0.4, 0.4, 0.2], (64, 1))
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (64, 1))
    cells = cells.sort_values("cell")
    bucket, n = cells["cell"].to_numpy() >> 24, cells["n"].to_numpy()
    p = np.stack([cells["p2"] / n, cells["p1"] / n, np.full(len(n), 1 / (v + 1))], axis=1)
    for _ in range(EM_ROUNDS):
        joint = a[bucket] * p
        share = joint / joint.sum(axis=1, keepdims=True) * n[:, None]
        # A token's weight of each estimate is added, so that none is 0 for good.
        total = np.stack([np.bincount(bucket, weights=share[:, k], minlength=64) for k in range(3)], axis=1) + [0.0, 0.5, 0.5]
        a = total / total.sum(axis=1, keepdims=True)
    return a


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _score(weights: np.ndarray, n: int, v: int):
    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                b, pair, context, word = _counts(row)
                p2, p1 = shares(pair, context, word, n)
                a = weights[bucket_of(context)]
                score = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] / (v + 1))
                base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
                known, score, base = (np.add.reduceat(x, b.starts) for x in ((word > 0).astype(np.int64), score, base))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths, pa.int64()),
                     pa.array(known, pa.int64()), pa.array(np.full(len(known), n), pa.int64()),
                     pa.array(base, pa.float64()), pa.array(score, pa.float64())], [c.split()[0] for c in SCORED.split(", ")])

    return run


def lm_scores(docs: DataFrame, fold: int = 10) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text), learnt from those whose crc32 of
    doc_id modulo ``fold`` is not 0. ``score`` is the model's log10
    probability, ``base_score`` that of the smoothed word frequencies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       (crc_mod(F.col("doc_id"), fold) == 0).alias("held"))
    coded = written(rows.mapInArrow(_code, CODED), "coded")
    sizes = coded.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    words = totals(coded, "words", sizes[1] or 0)
    seen = words.agg(F.sum("n_seen"), F.sum("n_all")).first()
    v, n = seen[0] or 0, seen[1] or 0
    pairs = totals(coded, "pairs", sizes[0] or 0)
    answers = [t.groupBy("block").agg(F.collect_list(F.struct("range", "answer")).alias(name))
               for t, name in ((words, "word_totals"), (pairs, "pair_totals"))]
    met = coded.join(answers[0], "block").join(answers[1], "block")
    cells = met.mapInArrow(_cells(n), "cell long, n double, p2 double, p1 double").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).toPandas()
    return met.mapInArrow(_score(learn_weights(cells, v), n, v), SCORED)
