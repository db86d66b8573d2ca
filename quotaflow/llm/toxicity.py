"""Toxicity by a convolutional text classifier, trained in numpy.

A word is embedded by the sum of hashed rows: the word's and those of its first
letters, so that a word never met shares what is known of its stem. Filters of
several widths run over the words, each keeps its greatest response in the text
(max pooling), and a logistic layer reads these. Gradients pass only through
the words that gave a maximum, so training is sparse; steps are Adagrad's.

A part of the sample is set aside for calibration: for each language the raw
threshold of best F1 is moved to ``threshold``. The language is guessed from
the text by a naive Bayes table over the hashed words, never read from a column.

The fit uses every labelled row, whole texts, in tasks: after a first start on
one share of the rows, each task trains a copy of the model on its own share and
the copies are averaged, a table row over the tasks that met it, once a pass.
Languages are counted and thresholds found over all rows as well; raw scores are
counted by thousandths for that. Only one model a pass, and counts of fixed size,
reach the driver. Every text is scored whole; a filter is a sum of table rows, added up
once a distinct word.

Defined results: raw scores beyond 30 count as 30 in the calibration; null and empty texts score as a text without words; without
labelled rows of both kinds all score 0; a null doc_id counts as empty text for
its fold; of labels that share a doc_id the greatest holds; equal rows score
alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import crc_mod, discard, free_shuffles, written

TABLE = 1 << 15  # rows of each hashed table
STEMS = (4, 5)  # bytes of a word's start
DEPTH = 8
FILTERS = 4  # of each width
WIDTHS = (1, 2, 3)
EPOCHS = 12  # passes over few rows; many rows are met at least LEAST_EPOCHS times
LEAST_EPOCHS = 3
ENOUGH = 100_000  # rows met in training, after which fewer passes do
SHARE, WORKERS = 4000, 16  # rows that make a further task worth it, and most tasks
BATCH = 32
RATE = 0.15
KNOWN_WORDS = 150_000  # words whose filter sums a worker remembers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ASCII letters lower-cased, other ASCII characters to a space; the rest stays.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def cells_of(words: list[bytes]) -> np.ndarray:
    """Rows of the hashed tables for each word, (words, 1 + stems)."""
    import xxhash

    h = xxhash.xxh32_intdigest
    flat = [h(w[:n] if n else w, n) % TABLE for w in words for n in (0, *STEMS)]
    return np.array(flat, np.int64).reshape(len(words), 1 + len(STEMS))


class TextConvolution:
    """Embeddings (tables, TABLE, DEPTH), filters by width (width, DEPTH,
    FILTERS), the logistic layer, and the languages' thresholds."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.tables = rng.normal(0, 0.1, (1 + len(STEMS), TABLE, DEPTH))
        self.filters = [rng.normal(0, 0.4, (w, DEPTH, FILTERS)) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
        self.out_bias = np.zeros(1)
        self.seen_tables = np.full(self.tables.shape, 1e-3)
        self.seen_filters = [np.full(f.shape, 1e-3) for f in self.filters]
        self.seen_out = np.full((3, len(self.out)), 1e-3)
        self.shifts = np.zeros(1)
        self.speech = np.zeros((TABLE, 1))

    def pooled(self, cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Greatest responses, where each filter had them, and the embeddings
        of the words, blank rows after them."""
        pad = max(WIDTHS)
        x = np.zeros((len(cells) + pad, DEPTH))
        for t in range(cells.shape[1]):
            x[:len(cells)] += self.tables[t][cells[:, t]]
        n = max(1, len(cells))
        best, where = [], []
        for f in self.filters:
            z = sum(x[j:n + j] @ f[j] for j in range(len(f)))
            at = z.argmax(axis=0)
            best.append(z[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best), where, x

    def raw(self, cells: np.ndarray) -> float:
        h = np.maximum(self.pooled(cells)[0] + self.bias, 0)
        return float(h @ self.out + self.out_bias[0])

    def small(self) -> list[np.ndarray]:
        """All that training changes but the tables: values, then sums of squared gradients."""
        return [*self.filters, self.bias, self.out, self.out_bias, *self.seen_filters, self.seen_out]

    def parts(self) -> list[np.ndarray]:
        """All that training changes: each table with its squared gradients' sums,
        (2, TABLE, DEPTH), then the rest in one row."""
        return [*map(np.stack, zip(self.tables, self.seen_tables)), np.concatenate([v.ravel() for v in self.small()])]

    def meet(self, texts: list[np.ndarray], labels: np.ndarray, rarity: float) -> None:
        """One pass over some rows; ``rarity`` is the weight of a label 1."""
        weight = np.where(labels == 1, rarity, 1.0)
        order = self.rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            self.step(order[start:start + BATCH], texts, labels, weight)

    def change(self, part: int, copies: list[np.ndarray]) -> np.ndarray:
        """How one of the parts moves to the mean of trained copies of it; a table's
        row and its gradients are averaged over the copies that changed it."""
        before = self.parts()[part]
        total = sum(c - before for c in copies)
        if part == len(self.tables):
            return total / len(copies)
        own = before[1].astype(np.float32)
        moved = sum((c[1] != own).any(axis=1, keepdims=True).astype(np.float32) for c in copies)
        return total / np.maximum(moved, 1)

    def move(self, part: int, change: np.ndarray) -> None:
        if part < len(self.tables):
            self.tables[part] += change[0]
            self.seen_tables[part] += change[1]
            return
        small = self.small()
        for v, c in zip(small, np.split(change, np.cumsum([v.size for v in small])[:-1])):
            v += c.reshape(v.shape)

    def step(self, rows, texts, labels, weight) -> None:
        grad_f = [np.zeros_like(f) for f in self.filters]
        grad_out, grad_bias, grad_b = np.zeros_like(self.out), np.zeros_like(self.bias), 0.0
        touched, pulls = [], []
        for r in rows:
            cells = texts[r]
            best, where, x = self.pooled(cells)
            h = np.maximum(best + self.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias[0], -30, 30)))
            g = weight[r] * (p - labels[r]) / len(rows)
            grad_out += g * h
            grad_b += g
            gh = g * self.out * (h > 0)
            grad_bias += gh
            for k, (f, at) in enumerate(zip(self.filters, where)):
                gk = gh[k * FILTERS:(k + 1) * FILTERS]
                for j in range(len(f)):
                    grad_f[k][j] += x[at + j].T * gk
                    real = at + j < len(cells)
                    touched.append(cells[(at + j)[real]])
                    pulls.append((f[j] * gk).T[real])
        for f, g, s in zip(self.filters, grad_f, self.seen_filters):
            g += 1e-5 * f
            s += g * g
            f -= RATE * g / np.sqrt(s)
        for i, (value, g) in enumerate(((self.out, grad_out + 1e-5 * self.out), (self.bias, grad_bias))):
            self.seen_out[i] += g * g
            value -= RATE * g / np.sqrt(self.seen_out[i])
        self.seen_out[2] += grad_b * grad_b
        self.out_bias -= RATE * grad_b / np.sqrt(self.seen_out[2][0])
        cells, pull = np.concatenate(touched), np.concatenate(pulls)
        for t in range(cells.shape[1]):
            at, back = np.unique(cells[:, t], return_inverse=True)
            g = np.zeros((len(at), DEPTH))
            np.add.at(g, back, pull)
            self.seen_tables[t][at] += g * g
            self.tables[t][at] -= RATE * g / np.sqrt(self.seen_tables[t][at])

    def learn_speech(self, counts: np.ndarray) -> None:
        """Naive Bayes log odds of the languages from counts (TABLE, languages)."""
        p = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0))
        self.speech = p - p.mean(axis=1, keepdims=True)

    def spoken(self, cells: np.ndarray) -> int:
        return int(self.speech[cells[:, 0]].sum(axis=0).argmax()) if len(cells) else 0

    def calibrate(self, found: np.ndarray) -> None:
        """The raw threshold of best F1 by guessed language, from rows (language,
        raw in thousandths, label 1 count, count); a language with few rows of
        either kind takes that of all."""
        def best(rows: np.ndarray) -> float:
            at, back = np.unique(-rows[:, 1], return_inverse=True)
            hit, met = (np.cumsum(np.bincount(back, rows[:, c])) for c in (2, 3))
            i = int((2 * hit / (met + hit[-1])).argmax())
            low = at[i + 1] if i + 1 < len(at) else at[i] + 1000
            return float(-(at[i] + low) / 2000)

        both = lambda rows: 0 < rows[:, 2].sum() < rows[:, 3].sum()
        self.shifts = np.full(self.speech.shape[1], best(found) if both(found) else 0.0)
        for k in range(len(self.shifts)):
            rows = found[found[:, 0] == k]
            if both(rows) and rows[:, 2].sum() >= 10:
                self.shifts[k] = best(rows)

    def tables_by_word(self) -> np.ndarray:
        """(tables, TABLE, taps + languages): each row's part in every filter
        position, and for the word's own table in the languages' log odds."""
        taps = [t @ f[j] for f in self.filters for j in range(len(f)) for t in [self.tables]]
        speech = np.zeros((len(self.tables), TABLE, self.speech.shape[1]))
        speech[0] = self.speech
        return np.concatenate([*taps, speech], axis=2).astype(np.float32)


class Scorer:
    """Scores texts with the sums of ``tables_by_word`` of known words."""

    def __init__(self, model: tuple, threshold: float) -> None:
        self.parts, self.bias, self.out, self.out_bias, self.shifts = model
        self.threshold = threshold
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((KNOWN_WORDS, self.parts.shape[2]), np.float32)

    def numbers(self, words: list[bytes]) -> list[int]:
        new = list(set(words).difference(self.number))
        if len(self.number) + len(new) > KNOWN_WORDS:
            self.number.clear()
            new = list(set(words))
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]), np.float32)
        if new:
            cells, start = cells_of(new), len(self.number)
            self.rows[start:start + len(new)] = sum(self.parts[t][cells[:, t]] for t in range(cells.shape[1]))
            self.number.update(zip(new, range(start, start + len(new))))
        return list(map(self.number.__getitem__, words))

    def score(self, text: bytes | None) -> float:
        words = words_of(text)
        n, pad = max(1, len(words)), max(WIDTHS)
        x = np.zeros((len(words) + pad, self.rows.shape[1]), np.float32)
        if words:
            x[:len(words)] = self.rows[self.numbers(words)]
        best, col = [], 0
        for w in WIDTHS:
            z = x[:n, col:col + FILTERS].copy()
            for j in range(1, w):
                z += x[j:n + j, col + j * FILTERS:col + (j + 1) * FILTERS]
            col += w * FILTERS
            best.append(z.max(axis=0))
        h = np.maximum(np.concatenate(best) + self.bias, 0)
        raw = float(h @ self.out + self.out_bias)
        raw -= self.shifts[int(x[:, col:].sum(axis=0).argmax())] if words else self.shifts[0]
        return 1 / (1 + np.exp(-np.clip(raw + np.log(self.threshold / (1 - self.threshold)), -30, 30)))


def _rows_of(batch) -> tuple[list[np.ndarray], np.ndarray]:
    cells = [np.frombuffer(c, np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int64) for c in batch.column("cells").to_pylist()]
    return cells, np.array(batch.column("toxic").to_pylist(), np.int64)


def _by_task(rows: DataFrame, work) -> list:
    """What ``work`` makes of the Arrow batches of each task, if not None."""
    def run(batches):
        made = work(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    return [pickle.loads(r.made) for r in rows.mapInArrow(run, "made binary").collect()]


def fit_toxicity(labelled: DataFrame) -> TextConvolution | None:
    """From (doc_id, text, lang, toxic), on all rows."""

    def cells(batches):
        for b in batches:
            found = [cells_of(words_of(t)).astype(np.uint16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "lang", "toxic")] + [pa.array(found, pa.binary())], ["doc_id", "lang", "toxic", "cells"])

    made = labelled.select("doc_id", "text", "lang", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        cells, "doc_id long, lang string, toxic int, cells binary")
    made = written(made.withColumn("deal", F.xxhash64("doc_id", "toxic", "cells")), "cells")
    aside = F.pmod(F.col("deal"), F.lit(4)) == 0
    n, n_train, hits = made.agg(F.count(F.lit(1)), F.count(F.when(~aside, 1)), F.coalesce(F.sum(F.when(~aside, F.col("toxic"))), F.lit(0))).first()
    if made.select("toxic").distinct().count() < 2:
        return None
    tasks = min(WORKERS, max(1, n_train // SHARE))
    # Dealt once by hash, in an order that any cluster repeats.
    dealt = written(made.repartition(tasks, "deal").sortWithinPartitions("deal", "doc_id"), "dealt")
    shares = dealt.coalesce(tasks)
    names = sorted(r.lang for r in made.where("lang is not null").select("lang").distinct().collect()) or ["und"]
    discard(made)
    spark = dealt.sparkSession
    model, context = TextConvolution(), spark.sparkContext
    shapes = [p.shape for p in model.parts()]
    rarity = float(np.sqrt((n_train - hits) / max(1, hits)))

    def one_pass(rows: DataFrame, number: int) -> None:
        shared = context.broadcast(cloudpickle.dumps(model))

        def work(batches):
            own, met = pickle.loads(shared.value), 0
            own.rng = np.random.default_rng(number)
            for b in batches:
                texts, labels = _rows_of(b)
                own.meet(texts, labels, rarity)
                met += len(texts)
            if met:
                made = [p.astype(np.float32).tobytes() for p in own.parts()]
                copy = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([copy] * len(made), pa.int32()),
                                                  pa.array(made, pa.binary())], ["part", "copy", "made"])

        def mean(copies):
            copies, learnt = copies.sort_by("copy"), pickle.loads(shared.value)
            part = copies.column("part")[0].as_py()
            arrays = [np.frombuffer(c.as_buffer(), np.float32).reshape(shapes[part]) for c in copies.column("made")]
            return pa.table({"part": pa.array([part], pa.int32()), "made": pa.array([learnt.change(part, arrays).tobytes()], pa.binary())})

        # Copies are averaged in tasks, a part of the model in each: the driver gets one model, not every copy.
        copies = rows.mapInArrow(work, "part int, copy int, made binary")
        for part, made in copies.groupBy("part").applyInArrow(mean, "part int, made binary").collect():
            model.move(part, np.frombuffer(made).reshape(shapes[part]))
        shared.destroy()
        free_shuffles(spark)

    train = shares.where(~aside)
    if tasks > 1:  # a common start, without which copies drift apart
        start = written(dealt.where(~aside & (F.pmod(F.floor(F.col("deal") / 4), F.lit(max(1, n_train // SHARE))) == 0)), "start")
        for i in range(EPOCHS // 2):
            one_pass(start.coalesce(1), 1000 + i)
        discard(start)
    for i in range(min(EPOCHS, max(LEAST_EPOCHS, -(-ENOUGH // max(1, n_train))))):
        one_pass(train, i)

    def speech(batches):
        counts = np.zeros((TABLE, len(names)), np.float32)
        for b in batches:
            for text, lang in zip(_rows_of(b)[0], b.column("lang").to_pylist()):
                if lang is not None:
                    at, often = np.unique(text[:, 0], return_counts=True)
                    counts[at, names.index(lang)] += np.minimum(often, 3)
        return counts

    model.learn_speech(sum(_by_task(shares, speech)).astype(np.float64))
    shared = context.broadcast(cloudpickle.dumps(model))

    def raw(batches):
        learnt = pickle.loads(shared.value)
        for b in batches:
            texts, labels = _rows_of(b)
            score = [int(np.floor(1000 * np.clip(learnt.raw(t), -30, 30))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([learnt.spoken(t) for t in texts], pa.int32()), pa.array(score, pa.int32()),
                                              pa.array(labels, pa.int64())], ["lang", "raw", "toxic"])

    found = dealt.where(aside).select("cells", "toxic").mapInArrow(raw, "lang int, raw int, toxic long").groupBy("lang", "raw").agg(
        F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n")).collect()
    discard(dealt)
    model.calibrate(np.array([tuple(r) for r in found], np.float64).reshape(-1, 4))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs`` (doc_id, text, lang),
    learnt from ``labels`` (doc_id, toxic) outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(crc_mod(F.col("doc_id"), fold) != held)
    model = fit_toxicity(docs.select("doc_id", "text", "lang").withColumn("text", F.col("text").cast("binary")).join(known, "doc_id"))
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), F.col("text").cast("binary").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    parts = (model.tables_by_word(), model.bias, model.out, float(model.out_bias[0]), model.shifts)
    shared = rows.sparkSession.sparkContext.broadcast(parts)  # tables of fixed size

    def run(batches):
        scorer = Scorer(shared.value, threshold)
        for b in batches:
            found = pa.array([scorer.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), found], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
