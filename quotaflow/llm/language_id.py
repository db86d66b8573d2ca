"""Language identification with a string kernel.

Features: which byte n-grams of lengths SPECTRUM the lower-cased text has
(presence, a blended spectrum), hashed to DIM bits. Kernel: the number of
shared n-grams over the geometric mean of the two numbers. Landmarks give the
Nystroem features, and kernel ridge regression learns one against the rest for
each language. Scoring multiplies a batch's presence matrix with the landmarks'.

The classifier is fitted on a bounded sample of labelled rows (``per_language``
of each language, least hash first) of whole texts; a row is DIM bits on the
driver. Every text is scored whole.

Defined results: null texts and texts without a letter are ``und`` with score
0; without labelled rows all are; ties go to the language first in order; equal
rows are judged alike; an empty table gives no rows; input columns with the
name of a result column are replaced.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import crc_mod, widened, without

SPECTRUM = (2, 3, 4)
DIM = 1 << 14
LANDMARKS = 48  # of each language
PER_LANGUAGE = 400
RIDGE = 0.1
BATCH = 512

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def presence(text: str | None, out: np.ndarray) -> None:
    """Set the cells of the text's n-grams in ``out`` (DIM) to 1."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = raw.copy()
    for n in range(2, max(SPECTRUM) + 1):
        if len(raw) < n:
            return
        code = (code[:-1] << np.uint32(8)) | raw[n - 1:]
        if n in SPECTRUM:
            cell = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
            out[cell >> np.uint32(32 - DIM.bit_length() + 1)] = 1


def matrix(texts: list) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(out, texts):
        presence(text, row)
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalized presence kernel of two sets of rows."""
    nx, ny = np.sqrt(x.sum(1)), np.sqrt(y.sum(1))
    return (x @ y.T) / np.maximum(nx[:, None] * ny[None, :], 1)


class LanguageModel:
    """languages, landmarks (presence rows) and the weights of their kernels."""

    def __init__(self, x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.languages = sorted(set(labels))
        of = np.array([self.languages.index(a) for a in labels])
        chosen = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(self.languages))])
        self.landmarks = np.packbits(x[chosen].astype(bool), axis=1)
        z = x[chosen]
        values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel(x, z) @ root
        target = np.where(of[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        # Each language weighs the same, however many rows it has.
        weight = 1.0 / np.bincount(of, minlength=len(self.languages))[of]
        weight *= len(of) / weight.sum()
        left = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
        shift = (target * weight[:, None]).sum(0) / weight.sum()
        self.shift = shift
        self.weights = root @ np.linalg.solve(left, features.T @ ((target - shift) * weight[:, None]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return kernel(x, z) @ self.weights + self.shift

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        s = self.scores(matrix(texts))
        best = s.argmax(1)
        return [self.languages[b] for b in best], np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1)


def fit_language_model(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """From (doc_id, text, lang). The sample is the ``per_language`` rows of
    least seeded hash; the window keeps no more in each task."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", F.xxhash64("text")))
    sample = labelled.where("lang is not null and text is not null").withColumn("_rank", rank).where(F.col("_rank") <= per_language)

    def bits(batches):
        for b in batches:
            packed = np.packbits(matrix(b.column("text").to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("_rank"), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "rank", "bits"])

    found = sample.select("lang", "_rank", "text").mapInArrow(bits, "lang string, rank int, bits binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "rank"])
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in found["bits"]]), axis=1).astype(np.float32)
    return LanguageModel(x, list(found["lang"]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` (text, ...) with lang_pred and score."""
    docs = without(docs, "lang_pred", "score")
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: bounded by their number

    def run(batches):
        m = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = [], []
            for i in range(0, len(texts), BATCH):
                found, s = m.predict(texts[i:i + BATCH])
                langs += found
                scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())],
                [*b.schema.names, "lang_pred", "score"])

    found = docs.mapInArrow(run, widened(docs, ("lang_pred", "string"), ("score", "double")))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise("und")).withColumn(
        "score", F.when(letters, F.col("score")).otherwise(0.0))


def language_id(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs`` (doc_id, text, lang),
    learnt from the rows outside the held-out fold."""
    rows = docs.withColumn("held_out", crc_mod(F.col("doc_id"), fold) == held)
    model = fit_language_model(rows.where("not held_out").select("doc_id", "text", "lang"))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
