"""Whitening of embeddings by a bit-sliced scatter matrix.

Each entry c becomes the integer x = floor(64 c) + 1000000. Covariances of such
shifted numbers lose their digits in floating point, so the products are summed
exactly:

1. One pass gives rows, least and greatest x and sum of x by dimension. Less its
   least value, a dimension is a number of few bits (covariances stay the same).
2. Each task packs bit plane a of dimension i over its rows into words of 64.
   The sum over rows of x_i x_j is the sum over planes a, b of 2^(a+b) times the
   ones in (plane a of i AND plane b of j). A task returns those counts by a + b,
   and Spark adds them up by (a + b, i, j).
3. On the driver n * cross - S_i S_j, centred as integers of any size, is divided
   by n^2 once, and ``eigh`` gives the components. What reaches the driver depends
   on the number of dimensions, not of rows.
4. Rows are projected in the tasks; the covariance of the result is summed by a
   pass of its own for ``identity_error``.

Defined results: rows whose vector is null, holds a null or non-finite entry, or
has another length than most vectors (of equally frequent lengths the greater)
are dropped; equal rows are whitened alike, rows with a null key too; an empty
table gives no rows; a component without variance (e within rounding of 0) has
null ``whitened`` and takes no part in ``identity_error``; ``deviation`` beyond a
long is null; x beyond a long raises; input columns other than the key and the
vector are left out, so none clashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 32
ENTRIES = 1 << 21  # vector entries worked on at once
LONG = (1 << 63) - 1

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vectors(df: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(key, v array<double>) rows of valid vectors, and their length."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above infinity
    valid = df.select(F.col(key), v.alias("v")).where(F.col("v").isNotNull()).where(finite)
    most = valid.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    return valid.where(F.size("v") == size), size


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, x) of at most ENTRIES entries each."""
    rows = max(ENTRIES // size, 64)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = np.floor(SCALE * c) + SHIFT
            if (np.abs(x) >= 2.0**62).any():
                raise OverflowError("an entry is too large for a long")
            yield part.column(0), x.astype(np.int64)


@dataclass
class Ranges:
    """Rows, and by dimension the least x, the bits of x - least, and the sum of x - least."""

    n: int
    least: np.ndarray
    bits: np.ndarray
    sums: list[int]


def ranges(rows: DataFrame, size: int) -> Ranges:
    def measure(batches):
        for _, x in blocks(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([len(x)] * size, pa.int64()), pa.array(x.min(0)),
                 pa.array(x.max(0)), pa.array(x.sum(0) if np.abs(x).max() < LONG // len(x) else x.astype(object).sum(0)).cast(pa.int64())],
                ["dim", "n", "least", "most", "total"])

    got = rows.mapInArrow(measure, "dim int, n long, least long, most long, total long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    if not got:
        return Ranges(0, np.zeros(size, np.int64), np.zeros(size, np.int64), [0] * size)
    n = got[0]["n"]
    least = np.array([r["least"] for r in got], np.int64)
    bits = np.array([(r["most"] - r["least"]).bit_length() for r in got], np.int64)
    return Ranges(n, least, bits, [int(r["total"]) - n * r["least"] for r in got])


def scatter_counts(x: np.ndarray, bits: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into[s, i, j]`` (i <= j) the ones shared by the planes a of
    dimension i and b of dimension j with a + b = s, over the rows of ``x``."""
    x = np.vstack([x, np.zeros((-len(x) % 64, x.shape[1]), np.int64)])
    owner = np.repeat(np.arange(len(bits)), bits)
    plane = np.concatenate([np.arange(b) for b in bits]) if len(owner) else owner
    packed = np.empty((len(owner), len(x) // 64), np.uint64)
    for k, (i, a) in enumerate(zip(owner, plane)):
        packed[k] = np.packbits((x[:, i] >> a) & 1).view(np.uint64)
    first = np.concatenate([[0], np.cumsum(bits)])
    for k, (i, a) in enumerate(zip(owner.tolist(), plane.tolist())):
        start = first[i]  # dimensions from i on
        ones = np.bitwise_count(packed[k] & packed[start:]).sum(1, dtype=np.int64)
        np.add.at(into, (a + plane[start:], i, owner[start:]), ones)


def cross_products(rows: DataFrame, size: int, r: Ranges) -> list[list[int]]:
    """Exact sums of (x_i - least_i)(x_j - least_j) over all rows."""
    least, bits = r.least, r.bits
    weights = max(2 * int(bits.max(initial=0)) - 1, 1)

    def count(batches):
        ones = np.zeros((weights, size, size), np.int64)
        for _, x in blocks(batches, size):
            scatter_counts(x - least, bits, ones)
        cell = np.flatnonzero(ones)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(ones.reshape(-1)[cell])], ["cell", "ones"])

    cells = rows.mapInArrow(count, "cell long, ones long").groupBy("cell").agg(F.sum("ones").alias("ones"))
    cross = [[0] * size for _ in range(size)]
    for cell, ones in cells.collect():  # at most weights x size x size
        s, i, j = cell // (size * size), cell // size % size, cell % size
        cross[i][j] += ones << s
        if i != j:
            cross[j][i] = cross[i][j]
    return cross


@dataclass
class Model:
    """n, the sums of x - least, least, and the components by falling variance."""

    n: int
    least: np.ndarray
    sums: list[int]
    bits: np.ndarray
    components: np.ndarray  # dimension x component
    variance: np.ndarray  # 0 where it is within rounding of 0
    explained: np.ndarray


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Model:
    r = ranges(rows, size)
    cross = cross_products(rows, size, r)
    n, s = r.n, r.sums
    v = np.array([[(n * cross[i][j] - s[i] * s[j]) / (n * n) for j in range(size)] for i in range(size)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    trace = sum(n * cross[i][i] - s[i] * s[i] for i in range(size)) / (n * n)
    floor = size * np.finfo(float).eps * max(e.max(initial=0), 0)
    kept = np.where(e[order] > floor, e[order], 0.0)
    return Model(n, r.least, s, r.bits, u[:, order], kept, kept / trace if trace else kept)


def project(x: np.ndarray, m: Model) -> tuple[list, np.ndarray]:
    """(deviation, whitened rows) of a block; a component without variance is NaN."""
    if m.n << int(m.bits.max(initial=0)) < LONG:
        d = m.n * (x - m.least) - np.array(m.sums, np.int64)
    else:
        d = m.n * (x - m.least).astype(object) - np.array(m.sums, object)
    about = (d.astype(float) ** 2).sum(1)
    fits = about < 0.99 * LONG  # no product or sum beyond a long
    deviation = [None] * len(x)
    for i, total in zip(np.flatnonzero(fits).tolist(), (d[fits] * d[fits]).sum(1).tolist()):
        deviation[i] = total
    for i in np.flatnonzero(~fits & (about < 1.01 * LONG)).tolist():
        total = sum(t * t for t in d[i].tolist())
        deviation[i] = total if total <= LONG else None
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(m.variance > 0, m.components / np.sqrt(m.variance), np.nan)
    return deviation, (d / m.n).astype(float) @ scaled


def identity_error(rows: DataFrame, size: int, m: Model) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity."""
    live = np.flatnonzero(m.variance > 0)
    k = len(live)
    if not k:
        return None

    def gram(batches):
        total = np.zeros((k + 1, k + 1))
        for _, x in blocks(batches, size):
            w = np.column_stack([project(x, m)[1][:, live], np.ones(len(x))])  # centred; the last column gives the means left
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], ["cell", "total"])

    sums = rows.mapInArrow(gram, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    g = np.zeros((k + 1) * (k + 1))
    for cell, total in sums:
        g[cell] = total
    g = g.reshape(k + 1, k + 1) / m.n
    return float(np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), one
    row per valid vector and component, the components by falling variance."""
    rows, size = vectors(df, key, column)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return df.sparkSession.createDataFrame([], schema)
    m = fit(rows, size, components)
    error = identity_error(rows, size, m)

    def out(batches):
        k = len(m.variance)
        for keys, x in blocks(batches, size):
            deviation, w = project(x, m)
            each = np.repeat(np.arange(len(x)), k)
            flat = w.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), m.n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                 pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(m.explained, len(x))),
                 pa.array([error] * len(each), pa.float64())],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
