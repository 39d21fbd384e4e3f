"""Operator 12 against numpy's eigenvalues, exact integers and the definition, and over edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from extremes.llm import queries, whitening


def check_pairs(a, k):
    values, vectors = whitening.leading_eigenpairs(a, k)
    size = max(np.abs(a).max(), 1e-300)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=2e-13 * size * len(a))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * values, atol=2e-13 * size * len(a))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 32, 64, 150])
def test_eigenpairs_of_random_matrices(n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n))
    check_pairs(b + b.T, n)
    check_pairs((b * np.logspace(0, -6, n)).T @ (b * np.logspace(0, -6, n)), min(n, 32))


def test_eigenpairs_of_clusters_and_of_little_rank():
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in ([5.0] * 40, [5.0] * 10 + [5 - 1e-9] * 10 + [1.0] * 20, [3.0, 2.0] + [0.0] * 38, np.r_[np.full(20, 2.0), np.arange(20) / 20]):
        check_pairs((q * values) @ q.T, 32)
    check_pairs(np.eye(12), 12)
    check_pairs(np.zeros((6, 6)), 6)
    check_pairs(np.diag([1e-200, 3e-200, 2e-200]), 3)
    w = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    check_pairs(w, 21)  # pairs of eigenvalues that agree to many digits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-4, 4), min_size=21, max_size=21))
def test_eigenpairs_of_small_integers(x):
    a = np.zeros((6, 6))
    a[np.triu_indices(6)] = x
    check_pairs(a + np.triu(a, 1).T, 6)


def definition(vectors, k):
    """x, n, S, deviations, eigenvalues and projections by numpy's solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s)] for v in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, deviation, values / np.trace(centred.T @ centred / n), centred @ basis / np.sqrt(values)


def check_rows(got, ids, vectors, k):
    n, deviation, explained, white = definition(vectors, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(ids) and len(got) == len(ids) * k and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    assert all(r.n == n for r in got) and [by[i][1].deviation for i in ids] == deviation
    mine = np.array([[by[i][j + 1].whitened for j in range(k)] for i in ids])
    signs = np.sign((mine * white).sum(axis=0))
    np.testing.assert_allclose(mine * signs, white, atol=1e-8)
    np.testing.assert_allclose([by[ids[0]][j + 1].explained for j in range(k)], explained, rtol=1e-9)
    np.testing.assert_allclose(mine.T @ mine / n, np.eye(k), atol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_rows(queries.op12_whitening(spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_left_out_rows_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(0, 2, 5).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4), (105, [1.0] * 4), (106, [1e30] + [0.0] * 4)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS component", "2 AS n", "3 AS i", "4 AS values").repartition(7)
    check_rows(whitening.whitened_vectors(df).collect(), [i for i, _ in good], [v for _, v in good], 5)
    twice = df.unionByName(df)
    got = whitening.whitened_vectors(twice, components=2).collect()
    assert len(got) == 240 and {r.n for r in got} == {120} and got[0].identity_error < 1e-9


def test_tables_without_variance_or_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened_vectors(df).count() == 0
    none = whitening.whitened_vectors(df.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = spark.createDataFrame([(i, [1.0 * i, 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitened_vectors(line).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_deviations_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    for top in (100, 1 << 30, 1 << 50):
        x = rng.integers(-top, top, (50, 6))
        s = [int(v) for v in x.astype(object).sum(axis=0)]
        want = [sum((50 * int(c) - t) ** 2 for c, t in zip(v, s)) for v in x]
        assert whitening._Mean(s, 50).deviation(x) == want
