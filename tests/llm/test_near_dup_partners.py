"""near_duplicates: which pairs are verified."""

import random

import numpy as np
import pytest

from quotaflow.llm import jaccard_join as J


def corpus():
    """120 texts with one passage in common and 12 groups of near copies that
    hold it as well, of sizes on both sides of powers of two."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(70)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(180)]) for _ in range(120)]
    for size in (20, 55, 60, 120, 180, 186, 190, 250, 430, 440, 450, 900):
        words = passage + [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for n in range(5):
            copy = list(words)
            for _ in range(len(words) * n // 120):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy + [f"w{rng.randrange(10**6)}" for _ in range(n * 3)]))
    return texts


def by_brute_force(texts, width, percent):
    shingler = J.Shingler(width)
    sets = [set(shingler.shingles(t.encode()).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize("most", [J.GROUP, 50])
def test_texts_that_share_a_passage_only_are_not_verified(spark, monkeypatch, most):
    wanted, verified = [], J.verified

    def counted(texts, pairs, width, percent):
        wanted.append(pairs.count())
        return verified(texts, pairs, width, percent)

    monkeypatch.setattr(J, "verified", counted)
    monkeypatch.setattr(J, "GROUP", most)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.near_duplicates(docs, 5, 80).collect()}
    assert got == by_brute_force(texts, 5, 80)
    if most > len(texts):
        assert wanted[0] <= 100, wanted


def test_no_linked_pair_is_left_out():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for size in (1, 2, 9, 31, 63, 64, 100, 127, 500, 1023, 5000, 9000):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).view(J.U))
            for part in np.linspace(0.75, 1, 12):
                b = np.unique(np.r_[a[:max(1, int(len(a) * part))], rng.integers(0, 1 << 63, int(size * (1 - part) / 3), dtype=np.int64).view(J.U)])
                both = len(np.intersect1d(a, b))
                near = J.may_link(np.array([len(a), len(b)]), [J.sketch(a), J.sketch(b)], percent)
                assert near[0, 1] == near[1, 0]
                assert near[0, 1] or 100 * both < percent * (len(a) + len(b) - both)


def test_members_of_a_hub_over_several_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.int64).view(J.U)) for _ in range(4)]
    docs = [(7, i, sets[i // 3][: 300 - i % 3]) for i in range(12)] + [(8, 8, sets[3]), (8, 20, sets[3][:299]), (9, 30, sets[0])]
    rows = [pa.RecordBatch.from_pydict({"hub": [h], "doc": [d], "n": [len(x)], "sketch": [J.sketch(x).tobytes()]}) for h, d, x in docs]
    found = sorted((h, d) for b in J._partners(80)(iter(rows)) for h, d in zip(b["hub"].to_pylist(), b["doc"].to_pylist()))
    assert found == [(0, 1), (0, 2), (3, 4), (3, 5), (7, 6), (7, 8), (8, 20), (9, 10), (9, 11)]
