"""Randomised singular values against an exact decomposition."""

import numpy as np
import pytest

from lexiforge.operators import reduction as R


def matrix(seed=0, n=300, d=40):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, 8)) * 2.0 ** -np.arange(8)) @ rng.standard_normal((8, d)) + 0.01 * rng.standard_normal((n, d)) + 0.3


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_dense(spark, method):
    a = matrix()
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(a)] + [(900, None), (901, [float("nan")] * 40)], "id int, embedding array<double>").repartition(5)
    b = a - a.mean(axis=0) if method == "pca" else a
    _, s, v = np.linalg.svd(b, full_matrices=False)
    rows = df.where("id < 900").select("embedding")
    values, vectors, _ = R.singular_vectors(rows, 40, 6, method == "pca")
    assert np.allclose(values, s[:6], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(vectors * v[:6].T, axis=0)), 1, atol=1e-6)
    got = {r.id: r.reduced for r in R.reduced(df, 6, method).collect()}
    assert got[900] is None and got[901] is None and len(got) == 302
    low = np.array([got[k] for k in range(300)])
    want = b @ v[:6].T
    assert np.allclose(np.abs(low), np.abs(want), atol=1e-5)


def test_sparse(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((200, 60)) < 0.1, rng.standard_normal((200, 60)), 0) @ np.diag(1.2 ** -np.arange(60.0))
    rows = [(k, [int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for k, r in enumerate(a)]
    df = spark.createDataFrame(rows, "id int, i array<int>, x array<double>").repartition(3)
    s = np.linalg.svd(a, compute_uv=False)
    values, _, _ = R.singular_vectors(df.select("i", "x"), 60, 5)
    assert np.allclose(values, s[:5], rtol=0.01)
    out = R.reduced(df, 5, vector="x", indices="i", width=60).collect()
    assert np.isclose(np.linalg.norm([r.reduced for r in out], axis=0), s[:5], rtol=0.01).all()


def test_no_rows_and_limits(spark):
    empty = spark.createDataFrame([], "id int, embedding array<float>")
    assert R.reduced(empty, 3).count() == 0
    with pytest.raises(ValueError):
        R.reduced(empty, 3, "other")
    one = spark.createDataFrame([(1, [3.0, 4.0])], "id int, embedding array<double>")
    assert abs(R.reduced(one, 5).first().reduced[0]) == pytest.approx(5)
