"""Whitening against a plain eigendecomposition, flat and steep spectra, few rows, odd input."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import SF
from wakeline.llm.whitening import fit_whitening, top_pairs, whiten, whole_numbers


def plain(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, q = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, values[::-1], q[:, ::-1]


def check(rows, vectors, k, tol=1e-7):
    x, n, s, c, values, q = plain([v for _, v in vectors])
    at = {i: j for j, (i, _) in enumerate(vectors)}
    assert len(rows) == len(vectors) * k
    z = np.zeros((len(vectors), k))
    for r in rows:
        j = at[r["vec_id"]]
        z[j, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in n * x[j] - s)
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9
    want = c @ (q[:, :k] / np.sqrt(values[:k]))
    for i in range(k):
        sign = np.sign(z[:, i] @ want[:, i])
        assert np.abs(z[:, i] * sign - want[:, i]).max() < tol


def test_the_table(spark):
    """Random vectors: a flat spectrum, the hard case, 64 dimensions against a block of 48."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(whiten(table.repartition(5)).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()], 32)


def test_steep_spectrum(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((300, 70)) @ np.diag(np.geomspace(300, 0.5, 70)) @ np.linalg.qr(rng.standard_normal((70, 70)))[0]
    vectors = [(i, v.tolist()) for i, v in enumerate(data)]
    check(whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), components=5).collect(), vectors, 5)


def test_few_rows_have_few_components(spark):
    vectors = [(i, [float(i), float(i * i), 1.0, 2.0]) for i in range(5)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    check(whiten(frame).collect(), vectors, 2)
    assert whiten(frame.limit(1)).count() == 0


@pytest.mark.parametrize("dims", [60, 150])
def test_recurrence_alone(dims):
    """The filter on matrices with clusters, a wide range, and rank below the block."""
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    for spectrum in (np.linspace(1, 1.2, dims), np.geomspace(1, 1e9, dims), np.r_[np.zeros(dims - 10), np.arange(1, 11)], np.r_[np.ones(dims - 8), np.full(8, 2.0)]):
        v = q @ np.diag(spectrum) @ q.T
        values, vectors, passes, residual = top_pairs(lambda b, v=v: v @ b, dims, 8)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], rtol=1e-10) and residual <= 1e-12
        assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * values[0] and passes < 300
    with pytest.raises(RuntimeError, match="not certified"):
        top_pairs(lambda b: q @ np.diag(np.linspace(1, 1.01, dims)) @ q.T @ b, dims, 8, guard=0, most_passes=5)


def test_odd(spark):
    rows = [
        (1, [1.0, 2.0, 3.0], "a"), (2, None, "a"), (3, [1.0, None, 3.0], None), (4, [math.nan, 1.0, 2.0], "b"), (5, [math.inf, 1.0, 2.0], "b"), (6, [1.0], "c"), (7, [], "c"),
        (None, [5.0, -2.0, 3.5], "d"), (8, [0.0, 0.0, 0.0], "d"), (8, [0.0, 0.0, 0.0], "d"), (9, [2.0, 7.0, -1.0], "e"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    got = whiten(frame).collect()
    assert sorted((r["vec_id"] or -1) for r in got if r["component"] == 1) == [-1, 1, 8, 8, 9]
    assert {r["n"] for r in got} == {5} and {r["component"] for r in got} == {1, 2, 3}
    empty = whiten(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(frame.filter("vec_id = 8")).count() == 0 and whiten(frame.filter("vec_id = 7")).count() == 0
    assert fit_whitening(whole_numbers(frame)).n == 5
