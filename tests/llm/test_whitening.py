"""Whitening against a dense solver."""

import numpy as np
import pytest

from strandlake.llm import whitening


def dense(x):
    """Eigenvalues and vectors of the covariance of rows, falling."""
    c = x - x.sum(axis=0) / len(x)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("dimension,spread", [(3, 1.0), (8, 2.0), (40, 1.2), (120, 1.05)])
def test_lobpcg(dimension, spread):
    rng = np.random.default_rng(dimension)
    q, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    v = q * spread ** -np.arange(dimension) @ q.T
    values, vectors = whitening.lobpcg(lambda b: v @ b, dimension)
    k = min(dimension, 8)
    assert np.allclose(values, spread ** -np.arange(k), rtol=1e-10)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-11
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)


def test_lobpcg_says_when_it_does_not_converge():
    v = np.diag(1 + 1e-9 * np.arange(200.0))
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: v @ b, 200, most=2, tolerance=1e-16)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((700, 24)) @ rng.standard_normal((24, 24)) * 0.1
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(m)] + [(5, m[5].tolist(), "x", 1), (None, m[6].tolist(), "y", 2)]
    bad = [(900, None), (901, [1.0] * 23 + [None]), (902, [float("nan")] * 24), (903, [1.0] * 23 + [float("inf")]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, "z", 3) for i, v in bad], "vec_id long, embedding array<double>, id string, x int").repartition(5)
    x = whitening.whole_numbers(df)
    f = whitening.fit(x)
    ints = np.floor(np.vstack([m, m[5], m[6]]) * 1024).astype(np.int64) + 100_000
    values, vectors = dense(ints.astype(float))
    assert f.sums.n == 702 and np.allclose(f.values, values[:8], rtol=1e-10) and np.isclose(f.trace, values.sum(), rtol=1e-12)
    assert whitening.identity_error(x, f) < 1e-9
    total = ints.sum(axis=0)
    got = {}
    for r in whitening.whiten(x, f).collect():
        got[r["id"]] = r
    assert {*got} == {*range(700), None}
    want = (ints - total / 702) @ vectors[:, :8] / np.sqrt(values[:8])
    signs = np.sign(np.sum(np.array([got[i]["whitened"] for i in range(700)]) * want[:700], axis=0))
    for i in range(700):
        assert int(got[i]["deviation"]) == sum((702 * int(a) - int(t)) ** 2 for a, t in zip(ints[i], total))
        assert np.allclose(np.array(got[i]["whitened"]) * signs, want[i], atol=1e-8)


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(i * 10**7), 1.0 - i]) for i in range(50)]
    x = whitening.whole_numbers(spark.createDataFrame(rows, "vec_id int, embedding array<double>"))
    ints = [[int(1024 * c) + 100_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*ints)]
    for r in whitening.whiten(x, whitening.fit(x)).collect():
        assert int(r["deviation"]) == sum((50 * a - t) ** 2 for a, t in zip(ints[r["id"]], total))


def test_vectors_without_spread(spark):
    empty = whitening.whole_numbers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    f = whitening.fit(empty)
    assert f.sums.n == 0 and whitening.whiten(empty, f).collect() == [] and whitening.identity_error(empty, f) == 0
    same = whitening.whole_numbers(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>"))
    f = whitening.fit(same)
    assert len(f.values) == 0 and [r["whitened"] for r in whitening.whiten(same, f).collect()] == [[]] * 3
    line = whitening.whole_numbers(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>"))
    assert len(whitening.fit(line).values) == 1
