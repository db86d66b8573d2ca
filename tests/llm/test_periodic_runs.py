"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib

from quotaflow.llm.periodic_runs import periodic_runs, planted, run_digest, run_tables, segments


def by_hand(w, shortest=24):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, 3 * q) and not any(
                    q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def patched(r):
    w = []
    for _ in range(r.randint(0, 8)):
        some = [f"w{r.randint(0, 30)}" for _ in range(r.choice([1, 2, 3, 5, 20]))]
        w += [r.choice(some) for _ in range(r.randint(1, 12))] * r.randint(1, 9)
        w = w[:-r.randint(1, 5)] if r.random() < 0.4 and len(w) > 5 else w
        w += [f"x{r.randint(0, 10**6)}"] if r.random() < 0.3 else []
    return w


def test_runs_equal_brute_force():
    r, found = random.Random(5), 0
    for _ in range(1500):
        w, shortest = patched(r), r.choice([3, 5, 8, 24])
        want = by_hand(w, shortest)
        found += len(want)
        assert periodic_runs(w, shortest) == want, (shortest, w)
    assert found > 2000


def test_segments_hold_frequent_words_only():
    r = random.Random(1)
    for _ in range(300):
        w = patched(r)
        for a, b in segments(w, 5):
            assert b - a >= 5 and all(w[a:b].count(x) >= 3 for x in set(w[a:b]))


def test_long_texts_end_soon():
    assert periodic_runs(["s"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs(["a", "b"] * 100_000) == [(0, 200_000, 2)]
    block = [str(random.Random(2).random()) for _ in range(20_000)]
    block = [f"{x}{i}" for i, x in enumerate(block)]
    assert periodic_runs([*block[-5:], *(block * 4)[:70_000]]) == [(0, 70_005, 20_000)]


def planted_by_hand(text, doc_id):
    w = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest_by_hand(w):
    runs = by_hand(w)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_on_small_table(spark):
    r = random.Random(8)
    rows = [(i, "\t".join(patched(r)), "clash") for i in range(120)]
    rows += [(None, "a b " * 30, "x"), (500, None, "x"), (501, "", "x"), (502, " \n ", None), (503, "é\x1cü " * 40, "x"),
             (504, "z " * 5000, "x"), (7, rows[7][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    texts = docs.withColumn("text", planted(docs.text, docs.doc_id))
    got = sorted(map(tuple, run_digest(run_tables(texts)).collect()), key=repr)
    assert got == sorted(((i, *digest_by_hand(planted_by_hand(t, i))) for i, t, _ in rows), key=repr)
    assert run_digest(run_tables(docs.where("false"))).count() == 0
