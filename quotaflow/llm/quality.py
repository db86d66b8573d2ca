"""Quality rules by compression bands.

A text's zstandard ratio (compressed / raw bytes) tells repetitive text (low)
from random text (high), but it falls with length, so the limits come in bands
of length. The whole text is judged, and every chunk of CHUNK bytes of a longer
text (the last, shorter one by the band of its length), which finds a
repetitive or random stretch in an otherwise normal text.

Defined results: null and empty texts have no words and fail the base rules;
equal rows are judged alike; an empty table gives no rows; texts of any length
are judged whole; input columns with the name of a result column are replaced.
"""

from __future__ import annotations

import sys
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import WS, widened, without

LEVEL = 3
CHUNK = 4096
# Fixed limits: (bytes below which the band holds, least ratio, greatest ratio).
# The greatest lies between clean prose at the band's least length (English,
# German, French, Spanish; Chinese and Japanese have a little more) and random
# letters and digits in words of 8 or 9 at its greatest. Below 192 bytes the two
# are alike, as the frame's own bytes rule.
BANDS = (
    (64, 0.00, float("inf")),
    (192, 0.30, 1.30),
    (224, 0.30, 0.90),
    (256, 0.30, 0.88),
    (320, 0.30, 0.85),
    (384, 0.30, 0.825),
    (512, 0.30, 0.795),
    (768, 0.30, 0.755),
    (1024, 0.30, 0.72),
    (1536, 0.28, 0.70),
    (2048, 0.28, 0.68),
    (4096, 0.28, 0.67),
    (16384, 0.26, 0.66),
    (65536, 0.22, 0.64),
    (float("inf"), 0.15, 0.64),
)
CHUNK_LIMITS = (0.20, 0.66)
CHUNK_SHARE = 0.05  # a text fails if more of its chunks are outside their limits
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
          ("n_repeat_words", "long"), ("zstd_ratio", "double"), ("bad_chunks", "double"))

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    grams = list(zip(*[words[i:] for i in range(width)]))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit, end = 0, 0
    for i, g in enumerate(grams):
        if g in often:
            hit += i + width - max(i, end)
            end = i + width
    return hit


def limits(size: int) -> tuple[float, float]:
    """Least and greatest ratio of a chunk of ``size`` bytes."""
    return CHUNK_LIMITS if size == CHUNK else next((low, high) for below, low, high in BANDS if size < below)


def measures(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The figures named in FIELDS for one whole text."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chunks = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) >= CHUNK else []
    bad = 0
    for c in chunks:
        low, high = limits(len(c))
        bad += not low <= len(packer.compress(c)) / len(c) <= high
    return (len(words), len(text) - sum(text.count(c) for c in WS), sum(text.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated_words(words),
            len(packer.compress(raw)) / len(raw) if raw else 0.0, bad / len(chunks) if chunks else 0.0)


def _measure(batches):
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        rows = [measures(t, packer) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) or [()] * len(FIELDS)
        kinds = {"long": pa.int64(), "double": pa.float64()}
        arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(cols, FIELDS)]
        yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, *[n for n, _ in FIELDS]])


def quality_bands(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with the measures, base_failed and kept."""
    docs = without(docs, *[n for n, _ in FIELDS], "base_failed", "kept")
    d = docs.mapInArrow(_measure, widened(docs, *FIELDS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    size = F.octet_length("text")
    low, high = F.lit(BANDS[-1][1]), F.lit(BANDS[-1][2])
    for below, least, most in reversed(BANDS[:-1]):
        low, high = F.when(size < below, least).otherwise(low), F.when(size < below, most).otherwise(high)
    fits = F.col("zstd_ratio").between(low, high) & (F.col("bad_chunks") <= CHUNK_SHARE)
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(fits, F.lit(False)))
