"""Whitening against numpy's eigenvalue routine and exact integer sums."""

import math

import numpy as np
import pytest

from tabwright.llm.whitening import by_component, eigen, fit_whitening, polar, whiten

SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def checked_eigen(matrix):
    values, vectors = eigen(matrix)
    scale = np.abs(matrix).max() or 1.0
    assert (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-13 * len(matrix)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * len(matrix) * scale
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() < 1e-13 * len(matrix) * scale


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 130])
def test_spectral_division(size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    for values in (
        rng.normal(size=size) ** 2,
        np.ones(size),  # one eigenvalue
        np.zeros(size),
        np.arange(size) // 3 + 1.0,  # triples, and shifts that are eigenvalues
        10.0 ** -np.arange(size),  # from 1 to nothing
        np.concatenate([[1e6], np.full(size - 1, 1.0)]),
    ):
        matrix = (q * values) @ q.T
        checked_eigen((matrix + matrix.T) / 2)
    checked_eigen(np.diag(np.arange(size, dtype=float)))


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    values = np.concatenate([-(10.0 ** -np.arange(10)), 10.0 ** -np.arange(10)])
    assert np.abs(polar((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-6


def vectors():
    rng = np.random.default_rng(8)
    data = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) / 4 + 3).astype(np.float32)
    data[100:250] = data[3]  # counts once in what is learned
    out = [(n, v.tolist(), "x", 1) for n, v in enumerate(data)]
    size = 12
    out[30] = (30, None, "x", 1)
    out[31] = (31, [math.nan] + [0.5] * (size - 1), "x", 1)
    out[32] = (32, [None] + [0.5] * (size - 1), "x", 1)
    out[33] = (33, [math.inf] * size, "x", 1)
    out[34] = (34, [], "x", 1)
    out[35] = (35, [1.0, 2.0], "x", 1)
    out[36] = (36, [1e30] * size, "x", 1)
    return [*out, out[60], (None, out[1][1], "x", 1)]


def test_rows_equal_a_plain_version(spark):
    data = vectors()
    out = by_component(whiten(spark.createDataFrame(data, SCHEMA).repartition(5))).collect()
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, *_ in data if i not in range(30, 37)]
    fit = np.unique(np.stack([x for _, x in good]), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in out) == sorted((-1 if i is None else i, c) for i, _ in good for c in range(1, 5))
    by_id = {i: x for i, x in good}
    signs = {}
    for r in sorted(out, key=lambda r: (r.vec_id is None, r.vec_id)):
        x, c = by_id[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == int(((n * x - sums) ** 2).sum())
        expected = (x - sums / n) @ basis[:, c] / math.sqrt(values[c])
        sign = signs.setdefault(c, 1 if expected * r.whitened > 0 else -1)
        assert abs(sign * expected - r.whitened) < 1e-9
        assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-12 and r.identity_error < 1e-9


def test_flat_directions_and_few_dimensions(spark):
    flat = spark.createDataFrame([(n, [float(n % 7), 1.0, 2.0 * (n % 7)]) for n in range(50)], "vec_id long, embedding array<double>")
    row = whiten(flat).where("vec_id = 3").first()
    assert len(row.whitened) == 3 and row.whitened[0] is not None and row.whitened[1:] == [None, None]
    assert abs(row.explained[0] - 1) < 1e-12 and row.explained[2] < 1e-12
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.deviation, r.n, r.explained, r.identity_error) for r in same] == [([None, None], 0, 1, [None, None], None)] * 2


def test_large_deviations(spark):
    df = spark.createDataFrame([(n, [float(1 << 30), float(n << 28)]) for n in range(8)], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whiten(df).collect()] == [None] * 8  # beyond 64 bits
    fitted = fit_whitening(df)
    assert fitted.sums == (8 << 38, 28 << 36) and fitted.identity_error < 1e-9


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whiten(df).count() == 0 and by_component(whiten(df)).count() == 0
