"""Runs of words that repeat with a period, by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q and at least
max(``shortest``, 3 q) words that neither neighbour extends at that period. Each
of its words occurs three times or more inside it, so

1. a word with fewer than three occurrences in a segment is in no run of it and
   splits it; the parts are counted anew and split until none has such a word
   (parts under ``shortest`` words are left). Of a segment's parts all but the
   longest are counted; that one's counts are the segment's less theirs, so the
   work is n log n.
2. segments that survive are scanned lag by lag. A run of period q matches
   itself at lag q over max(shortest - q, 2 q) places at least and so over a
   multiple of that number; only those places are compared, about n log n in
   all, and a match is followed to both ends of its stretch.

A lag's stretch is a run unless a divisor of the lag is a period of it too. No
run is lost at a segment's ends: the word beyond is in no run of the segment
around, so it extends none.

Defined results: null and empty texts have no runs and collapse to an empty
text; equal rows have equal runs; an empty table gives no rows; a text of any
length is read whole; input columns with the name of a result column are
replaced.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import WS, crc, widened, without, word_count

SHORTEST = 24  # words of the shortest run
REPEATS = 3  # times that a run holds its period at least
FIRST_PAIRS, PAIRS = 1 << 13, 1 << 20  # places compared at once, doubling from the first to the last

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUNS = "array<struct<start:long,length:long,period:long>>"


def segments(words: list, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Stretches [start, end) in which every word occurs REPEATS times."""
    counts = Counter(words)
    if len(words) < shortest or max(counts.values()) < REPEATS:
        return []
    places: dict = {w: [] for w, n in counts.items() if n >= REPEATS}
    rare_places = []
    for i, w in enumerate(words):
        if w in places:
            places[w].append(i)
        else:
            rare_places.append(i)
    found = []
    # (start, end, counts, words that may be rare, places of rare words if known)
    todo = [(0, len(words), counts, (), rare_places)]
    while todo:
        start, end, counts, doubtful, cuts = todo.pop()
        if cuts is None:
            cuts = []
            for w in doubtful:
                n = counts.get(w, 0)
                if 0 < n < REPEATS:
                    at = places.get(w)
                    if at:
                        first = bisect_left(at, start)
                        cuts += at[first:first + n]
            cuts.sort()
        if not cuts:
            found.append((start, end))
            continue
        edges = [start - 1, *cuts, end]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:]) if b - a > 1]
        parts.sort(key=lambda p: p[1] - p[0])
        if not parts or parts[-1][1] - parts[-1][0] < shortest:
            continue
        touched: set = set()
        for a, b in parts[:-1]:
            own = Counter(words[a:b])
            counts.subtract(own)
            touched.update(own)
            if b - a >= shortest:
                todo.append((a, b, own, list(own), None))
        for i in cuts:
            counts[words[i]] -= 1
        todo.append((*parts[-1], counts, touched, None))
    return sorted(found)


def stretch(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest [a, b) around ``at`` where x[i] == x[i + lag] throughout."""
    a, step = at, 64
    while a > 0:
        low = max(a - step, 0)
        differ = np.flatnonzero(x[low:a] != x[low + lag:a + lag])
        if len(differ):
            a = low + int(differ[-1]) + 1
            break
        a, step = low, step * 2
    b, step, end = at + 1, 64, len(x) - lag
    while b < end:
        high = min(b + step, end)
        differ = np.flatnonzero(x[b:high] != x[b + lag:high + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = high, step * 2
    return a, b


def smallest_period(x: np.ndarray, start: int, period: int) -> bool:
    """Whether no divisor of ``period`` is a period of a run that starts there."""
    block, left, prime = x[start:start + period], period, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        if left % prime == 0:
            part = period // prime
            if (block[part:] == block[:-part]).all():
                return False
            while left % prime == 0:
                left //= prime
        prime += 1
    return True


def lag_scan(x: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment of word numbers."""
    n, runs = len(x), []
    last = n // REPEATS
    lags = np.arange(1, last + 1)
    lags = lags[n >= np.maximum(shortest, REPEATS * lags)]
    step = np.maximum(shortest - lags, (REPEATS - 1) * lags)
    per_lag = -(-(n - lags) // step)  # compared places 0, step, 2 step, ...
    upto = np.cumsum(per_lag)
    known = np.zeros((3, 16), np.int64)  # start, end, period of the runs so far
    at, room = 0, FIRST_PAIRS
    while at < len(lags):
        done = int(upto[at - 1]) if at else 0
        stop = max(int(np.searchsorted(upto, done + room, "right")), at + 1)
        room = min(2 * room, PAIRS)
        counts = per_lag[at:stop]
        which = np.repeat(np.arange(at, stop), counts)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)) * step[which]
        hit = np.flatnonzero(x[place] == x[place + lags[which]])
        place, lag, half = place[hit], lags[which[hit]], step[which[hit]] // 2
        # Inside a known run a multiple of its period matches all over and is no run.
        for s, e, d in known[:, : min(len(runs), 16)].T.tolist():
            open_ = (place < s) | (place + lag >= e) | (lag % d != 0)
            place, lag, half = place[open_], lag[open_], half[open_]
        # The stretch has half its least length on one side of the place.
        left = right = np.ones(len(place), bool)
        for near in (1, 2, 3, 5, 8, None):
            k = half if near is None else np.minimum(near, half)
            before, after = np.maximum(place - k, 0), np.minimum(place + k, n - 1 - lag)
            left = left & (place >= k) & (x[before] == x[before + lag])
            right = right & (after == place + k) & (x[after] == x[after + lag])
            keep = left | right
            place, lag, half, left, right = place[keep], lag[keep], half[keep], left[keep], right[keep]
        seen_lag = seen_end = -1
        for p, q in zip(place.tolist(), lag.tolist()):
            if q == seen_lag and p < seen_end:
                continue
            if runs:
                s, e, d = known[:, : len(runs)]
                if ((s <= p) & (e > p + q) & (q % d == 0)).any():
                    continue
            a, b = stretch(x, p, q)
            seen_lag, seen_end = q, b
            if b - a >= max(shortest - q, (REPEATS - 1) * q) and smallest_period(x, a, q):
                if len(runs) == known.shape[1]:
                    known = np.hstack([known, known])
                known[:, len(runs)] = a, b + q, q
                runs.append((a, b - a + q, q))
        at = stop
    return runs


def periodic_runs(words: list, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word list, by start and period."""
    runs = []
    for start, end in segments(words, shortest):
        numbers: dict = {}
        x = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words[start:end]), np.int32, end - start)
        runs += [(start + s, length, period) for s, length, period in lag_scan(x, shortest)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words less what repeats in a run after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def run_tables(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (text, ...) with runs (array of start, length, period, by start
    and period) and collapsed (the kept words, joined by a space)."""
    docs = without(docs, "runs", "collapsed")
    schema = widened(docs, ("runs", RUNS), ("collapsed", "string"))
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def find(batches):
        for b in batches:
            runs, kept = [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode("utf-8").split()  # ASCII white space only
                found = periodic_runs(words, shortest)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(collapse(words, found).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, kind), pa.array(kept, pa.string())],
                                             [*b.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(find, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's input: of a document with crc32(doc_id) % 10 = 0 the words
    from a on become the first p of them over and over; others as they are."""
    h = crc(doc_id)
    words = F.array_remove(F.split(F.translate(text, WS, " " * len(WS)), " ", -1), "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    times = F.floor((n - a + p - 1) / p).cast("int")
    turned = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    planted_text = F.array_join(F.concat(F.slice(words, F.lit(1), a), turned), " ")
    return F.when((h % 10 == 0) & (word_count(text) > 0), planted_text).otherwise(text)


def run_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``runs`` and ``collapsed``."""
    better = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
