"""Whitened embeddings against numpy's eigenvectors and whole-number sums."""

import math

import numpy as np
import pytest

from quaytally.llm.whitening import Spectrum, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, deviation int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def held(df, vectors, components=8):
    """Checks the rows of a table whose vectors are all kept, ids 0, 1, ..."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    cov = z.T @ z / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(components, d)
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c + 1) for i in range(n) for c in range(k)]
    assert {r.n for r in rows} == {n}
    assert [r.deviation for r in rows[::k]] == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    got = np.array([r.whitened for r in rows]).reshape(n, k)
    assert np.allclose([r.explained for r in rows[:k]], e[:k] / np.trace(cov), rtol=1e-9, atol=1e-12)
    return got, z, e, vec, rows[0].identity_error


def test_rows_are_whitened(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 24)) @ rng.standard_normal((24, 24))).astype(np.float32)
    got, z, e, vec, error = held(whitened(frame(spark, vectors.tolist())), vectors)
    expected = z @ vec[:, :8] / np.sqrt(e[:8])
    for c in range(8):
        assert min(np.abs(got[:, c] - s * expected[:, c]).max() for s in (1, -1)) < 1e-8
    assert error < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9


def test_equal_eigenvalues_and_fewer_dimensions_than_components(spark):
    vectors = [[s if i == j else 0.0 for j in range(3)] for i in range(3) for s in (1.0, -1.0)]
    got, *_, error = held(whitened(frame(spark, vectors)), vectors)
    assert error < 1e-9 and np.abs(np.cov(got.T, bias=True) - np.eye(3)).max() < 1e-9


def test_dropped_rows_repeated_ids_and_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, 1], None, [1, None], [nan, 0], [1, inf], [-inf, 2], [0.25, -3], [0.25, -3], [2, 2], [1, 2, 3], []]
    ids = [7, 1, 2, 3, 4, 5, None, None, 7, 9, 10]
    rows = whitened(frame(spark, vectors, ids)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in rows) == [(-1, 1), (-1, 1), (-1, 2), (-1, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert {r.n for r in rows} == {4} and rows[0].identity_error < 1e-9


def test_no_variance(spark):
    rows = whitened(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(rows) == 6 and {(r.whitened, r.deviation, r.explained, r.identity_error) for r in rows} == {(0.0, 0, 0.0, 1.0)}


def test_empty_tables(spark):
    assert whitened(frame(spark, [[1.0]]).limit(0)).collect() == []
    assert whitened(frame(spark, [None, [None]])).collect() == []


def test_very_large_entries_do_not_crash(spark):
    rows = whitened(frame(spark, [[1e30, 1.0], [-1e30, 2.0], [3.0, 3.0]])).collect()
    assert len(rows) == 6 and all(r.deviation is None for r in rows if r.vec_id < 2)


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_spectrum_equals_numpy(size):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    for values in (rng.standard_normal(size), np.repeat(3.0, size), np.r_[[5, 5, 5 - 1e-13, 1, 1], np.zeros(size)][:size], np.zeros(size), 10.0 ** -np.arange(size)):
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        k = min(8, size)
        e, v = Spectrum(matrix).leading(k)
        scale = max(np.abs(values).max(), 1e-300)
        assert np.abs(e - np.sort(values)[::-1][:k]).max() < 1e-13 * size * scale
        assert np.abs(matrix @ v - v * e).max() < 1e-13 * size * scale and np.abs(v.T @ v - np.eye(k)).max() < 1e-12


def test_counts_are_of_eigenvalues():
    spectrum = Spectrum(np.diag([4.0, 1.0, 1.0, -2.0]))
    assert spectrum.above(np.array([5.0, 3.0, 0.5, -1.0, -3.0])).tolist() == [0, 1, 3, 3, 4]
