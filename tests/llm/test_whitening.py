"""Whitening against numpy on exact integers."""

from collections import Counter

import numpy as np
import pytest

from quotaflow.llm.whitening import scatter_counts, whiten


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component string, n string").repartition(3)


def expected(vecs):
    x = np.floor(64 * np.array(vecs, float)).astype(int).astype(object) + 1_000_000
    n, s = len(x), x.sum(0)
    d = n * x - s
    v = np.array((d.T @ d).astype(object) / n**3, float)
    return x, s, (d * d).sum(1), v


def check(got, vecs, keys):
    x, s, deviation, v = expected(vecs)
    n, k = len(x), min(32, v.shape[0])
    assert len(got) == n * k and (got.n == n).all()
    assert Counter(got.vec_id.fillna(-1).astype(int)) == Counter([-1 if i is None else i for i in keys] * k)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    centred = np.array((x - s / n).astype(float))
    for i, key in enumerate(keys):
        mine = got[got.vec_id == key].sort_values("component")
        if len(mine) != k:  # a key that repeats, or null
            continue
        assert (mine.deviation == deviation[i]).all()
        w = centred[i] @ u[:, :k] / np.sqrt(e[:k])
        assert np.allclose(np.abs(mine.whitened), np.abs(w), atol=1e-7)
        assert np.allclose(mine.explained, e[:k] / np.trace(v), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_numpy(spark, kind):
    r = np.random.default_rng(3)
    vecs = (r.normal(size=(300, 5)) * [0.1, 1, 40, 0.5, 3] + [0, 900, -30_000, 5, 0]).astype(np.float32 if kind == "float" else float)
    good = [(i, v.tolist(), "c", "c") for i, v in enumerate(vecs)] + [(None, vecs[3].tolist(), "c", "c"), (7, vecs[7].tolist(), "c", None)]
    bad = [(900, None, "c", "c"), (901, [1.0, None, 0.0, 0.0, 0.0], "c", "c"), (902, [1.0, float("nan"), 0.0, 0.0, 0.0], "c", "c"),
           (903, [float("-inf")] * 5, "c", "c"), (904, [], "c", "c"), (905, [1.0], "c", "c")]
    got = whiten(table(spark, good + bad, kind)).toPandas()
    check(got, [v for _, v, *_ in good], [i for i, *_ in good])


def test_given_embeddings(spark, sf_small):
    from quotaflow.llm.queries import op13_whitening

    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    check(op13_whitening(spark, sf_small).toPandas(), [x.embedding for x in rows], [x.vec_id for x in rows])


def test_whitened_covariance_is_the_identity(spark):
    r = np.random.default_rng(5)
    vecs = r.normal(size=(400, 40)) @ r.normal(size=(40, 40))
    got = whiten(table(spark, [(i, v.tolist(), None, None) for i, v in enumerate(vecs)], "double")).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (400, 32)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(32)).max()
    assert error < 1e-9 and abs(error - got.identity_error.iloc[0]) < 1e-10


def test_few_or_equal_vectors(spark):
    got = whiten(table(spark, [(1, [0.5, 0.25], "", ""), (2, [0.5, 0.25], "", "")])).toPandas()
    assert len(got) == 4 and got.whitened.isna().all() and (got.deviation == 0).all() and got.identity_error.isna().all()
    line = whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0], "", "") for i in range(9)])).toPandas()
    assert line[line.component == 1].whitened.notna().all() and line[line.component > 1].whitened.isna().all()
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None, "", ""), (2, [], "", "")])).count() == 0


def test_large_entries_stay_exact(spark):
    vecs = [[1e12, 1.0], [-1e12, 2.0], [3e11, -5.0], [0.0, 0.0]]
    got = whiten(table(spark, [(i, v, "", "") for i, v in enumerate(vecs)], "double")).toPandas()
    _, _, deviation, v = expected(vecs)
    assert got.deviation.isna().all() and min(deviation) > 2**63  # beyond a long
    assert np.allclose(got[got.vec_id == 0].explained.iloc[0], np.linalg.eigvalsh(v)[-1] / np.trace(v))


def test_scatter_counts_are_exact():
    r = np.random.default_rng(1)
    x = np.column_stack([r.integers(0, 1 << b, 1000) for b in (1, 5, 0, 20, 33)])
    bits = np.array([1, 5, 0, 20, 33])
    ones = np.zeros((65, 5, 5), np.int64)
    scatter_counts(x, bits, ones)
    want = x.astype(object).T @ x.astype(object)
    for i in range(5):
        for j in range(i, 5):
            assert sum(int(c) << s for s, c in enumerate(ones[:, i, j])) == want[i, j]
