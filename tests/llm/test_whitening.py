"""Whitening against a dense eigendecomposition."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import bidiagonal, whitening

SF = "/root/testdata/sf0.001"


def random_orthogonal(d, seed=0):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


Q = random_orthogonal(24)
MATRICES = {
    "random": np.random.default_rng(1).normal(size=(40, 40)), "one": np.array([[3.0]]), "two": np.array([[1.0, 2.0], [0.0, 1e-9]]),
    "ties": Q @ np.diag([5.0] * 6 + [3.0] * 3 + [1.0] * 15) @ Q.T, "graded": Q @ np.diag(np.logspace(3, -3, 24)) @ Q.T,
    "close": Q @ np.diag(1 + 1e-9 * np.arange(24)) @ Q.T, "rank 3": Q @ np.diag([5.0, 4, 3] + [0.0] * 21) @ Q.T,
    "diagonal": np.diag(np.arange(9.0)), "equal": 2 * np.eye(7), "zero": np.zeros((5, 5)), "zero inside": np.diag([3.0, 0.0, 2.0]) + np.diag([1.0, 1.0], 1),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver_equals_dense_one(name):
    a = MATRICES[name]
    squares, v = bidiagonal.singular_directions(a, 8, 1e-20)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(squares, want, rtol=1e-9, atol=1e-24 + want[0] * 1e-26)
    k = v.shape[1]
    assert k == min(8, int((want > max(1e-20 * want[0], 1e-300)).sum()))
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-13)
    assert np.allclose(a.T @ a @ v, v * squares[:k], atol=1e-13 * max(want[0], 1e-300))


def test_bidiagonal_form():
    a = MATRICES["random"]
    d, e, w = bidiagonal.bidiagonalise(a)
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(w.T @ w, np.eye(len(a)), atol=1e-13)
    assert np.allclose(w.T @ a.T @ a @ w, b.T @ b, atol=1e-11)


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n = len(x)
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, e[::-1], v[:, ::-1]


def check(rows, vectors, keys, components=8):
    x, e, v = plain(vectors)
    n, d = x.shape
    k = min(components, d)
    sums = [int(s) for s in x.sum(axis=0)]
    assert len(rows) == n * k
    got = {}
    for r in rows:
        got.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-6)
    exact = {key: sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for key, row in zip(keys, x)}
    for c, part in got.items():
        part = {r["vec_id"]: r for r in part}
        w = (x - x.mean(axis=0)) @ v[:, c - 1] / math.sqrt(e[c - 1])
        have = np.array([part[key]["whitened"] for key in keys])
        assert np.allclose(have, w * np.sign(have @ w), atol=1e-8)
        assert all(part[key]["deviation"] == exact[key] for key in keys)


def test_equals_dense_version(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12)
    rows = [(k, [float(c) for c in v], "x", 1) for k, v in enumerate(vectors)]
    odd = [(-1, None, "x", 1), (-2, [None] + [1.0] * 11, "x", 1), (-3, [float("nan")] * 12, "x", 1), (-4, [float("inf")] + [0.0] * 11, "x", 1),
           (-5, [], "x", 1), (-6, [1.0] * 5, "x", 1), (-7, [1e30] * 12, "x", 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string, n int").repartition(37)
    got = whitening.whiten_rows(table, keep=("vec_id", "component", "n"))
    assert got.columns == ["vec_id", *whitening.RESULT]
    check(got.collect(), vectors, range(len(vectors)))
    fit = whitening.fit_whitening(table)
    out = whitening.apply_whitening(table, fit, out="component")
    assert out.columns == ["vec_id", "embedding", "n", "component"]
    w = np.array([r["component"] for r in out.collect()])
    assert w.shape == (3000, 8) and np.allclose(w.T @ w / 3000, np.eye(8), atol=1e-9)


def test_repeated_rows_ties_and_few_dimensions(spark):
    vectors = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)] * 3 + [(0.0, 0.0)] * 5
    table = spark.createDataFrame([(k, list(v)) for k, v in enumerate(vectors)] + [(0, list(vectors[0]))], "vec_id long, embedding array<float>")
    rows = whitening.whiten_rows(table).collect()
    assert len(rows) == 18 * 2
    w = np.array([[r["whitened"] for r in rows if r["component"] == c] for c in (1, 2)])
    assert np.allclose(w @ w.T / 18, np.eye(2), atol=1e-12)
    assert sum(r["vec_id"] == 0 for r in rows) == 4


def test_no_directions(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten_rows(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns == ["vec_id", *whitening.RESULT]


def test_large_entries_stay_exact(spark):
    vectors = [[k * 1.0e9, -3.0e12 * k * k] for k in range(8)]
    rows = whitening.whiten_rows(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), components=1).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    want = [sum((8 * a - sum(col)) ** 2 for a, col in zip(v, zip(*x))) for v in x]
    assert [r["deviation"] for r in sorted(rows)] == [t if t < 1 << 63 else None for t in want]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_given_vectors(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = whitening.whiten_rows(spark.read.parquet(f"{SF}/embeddings.parquet").select("*", F.lit(1).alias("whitened")))
    check(got.collect(), [r[1] for r in rows], [r[0] for r in rows])
