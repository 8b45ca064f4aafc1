"""Whitening: exact polynomial and roots, components of repeated roots, whole tables against double-precision decomposition."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_vectors import ODD, TABLE
from verivane.llm import whitening


def by_traces(m):
    """The characteristic polynomial by Faddeev and Leverrier's recurrence, from the constant up."""
    d = len(m)
    c, b = [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][x] * b[x][j] for x in range(d)) + (c[-1] if i == j else 0) * 1 for j in range(d)] for i in range(d)]
        c.append(-sum(m[i][x] * b[x][i] for i in range(d) for x in range(d)) // k)
    return c[::-1]


def gram(x):
    return [[int(v) for v in row] for row in x.astype(object).T @ x.astype(object)]


@pytest.mark.parametrize("shape, top", [((9, 5), 10), ((40, 7), 1 << 40), ((2, 5), 50), ((1, 1), 3)])
def test_the_polynomial_is_exact(spark, shape, top):
    m = gram(np.random.default_rng(1).integers(-top, top, shape))
    assert whitening.polynomial(spark, m) == by_traces(m)


def test_hessenberg_form_needs_a_swap():
    p, a = 10007, np.array([[1, 2, 3, 4], [0, 5, 6, 7], [8, 9, 1, 2], [0, 3, 4, 0]])
    h = whitening.hessenberg(a, p)
    assert not np.tril(h, -2).any()
    assert whitening.characteristic(a, p).tolist() == [v % p for v in by_traces(a.tolist())]


def poly(*roots):
    c = [1]
    for r in roots:
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    return c


def test_roots_repeated_close_and_zero():
    c = poly(0, 0, 5, 7, 7, 7, 10**20, 10**20 + 1)
    assert [whitening.beyond(c, Fraction(t)) for t in (-1, 0, 6, 7, 10**20)] == [8, 6, 5, 2, 1]
    roots = whitening.largest_roots(c, 3 * 10**20, 4)
    assert [t for _, t in roots] == [1, 1, 3]
    for (r, _), want in zip(roots, (10**20 + 1, 10**20, 7)):
        assert abs(r - want) < Fraction(want, 1 << 120)
    assert [t for _, t in whitening.largest_roots(poly(3, 4), 7, 4)] == [1, 1]


def test_components_of_close_roots_are_eigenvectors():
    # Two roots agree in 20 decimal places; doubles can't tell their vectors apart.
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])  # orthogonal, rows of length 2
    values = [4 * 10**20 + 4, 4 * 10**20, 8, 4]
    m = [[sum(int(q[k, i]) * int(q[k, j]) * values[k] for k in range(4)) // 4 for j in range(4)] for i in range(4)]
    for k, value in enumerate(values):
        (v,) = whitening.eigenvectors(m, Fraction(value), 1)
        assert np.allclose(np.abs(v @ q.T / 2), np.eye(4)[k], atol=1e-15)
    pair = np.array(whitening.eigenvectors([[5, 0, 0], [0, 5, 0], [0, 0, 1]], Fraction(5), 2))
    assert np.allclose(pair @ pair.T, np.eye(2)) and np.abs(pair[:, 2]).max() < 1e-30


def reference(x):
    u = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(u.T.astype(float), bias=True).reshape(x.shape[1], -1))
    return len(u), u.sum(0), e[::-1], (x - u.mean(0)) @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-30)), u


def test_whole_table(spark, small):
    rows = small("embeddings")
    got = whitening.whiten(rows).toPandas()
    table = rows.toPandas()
    x = np.floor(np.stack(table.embedding).astype(float) * 256).astype(np.int64)
    n, s, e, y, u = reference(x)
    assert len(got) == 4 * len(table) and set(got.n) == {n} and got.identity_error.max() < 1e-12
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(y[:, :4]), atol=1e-9)
    assert np.allclose(got.groupby("component").explained.first(), (e / e.sum())[:4], rtol=1e-12)
    off = got[got.component == 1].set_index("vec_id").loc[table.vec_id].deviation
    assert [int(v) for v in off] == ((n * x - s) ** 2).sum(1).tolist()


def test_copies_count_once_and_all_rows_return(spark):
    rows = [(i, v, 0) for i, v in enumerate([[0.5, 0.1], [0.5, 0.1], [0.5001, 0.1], [-0.25, 0.3], [0.75, -0.5]])]
    got = whitening.whiten(spark.createDataFrame(rows + [(None, [0.0, 0.0], 0)], TABLE)).collect()
    assert {r["n"] for r in got} == {4} and len(got) == 12  # three rows are one x
    value = {(r["vec_id"], r["component"]): (r["deviation"], r["whitened"]) for r in got}
    assert value[0, 1] == value[1, 1] == value[2, 1] and (None, 2) in value


def test_odd_rows_and_clashing_names(spark):
    rows = spark.createDataFrame(ODD + [(9, [0.9, -0.9], 3), (9, [0.9, -0.9], 3)], TABLE).withColumns({c: F.lit("x") for c in ("x", "v", "component", "n", "whitened", "deviation")})
    got = whitening.whiten(rows).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k) for i in (1, 2, 9, 9) for k in (1, 2))


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5, 0.5], 1)], [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)]])
def test_without_variance_there_is_no_component(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, TABLE))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.isEmpty()


def test_fewer_components_than_asked_where_the_rank_is_low(spark):
    line = [(i, [i / 8, -i / 4, 0.5], 0) for i in range(-3, 4)]
    got = whitening.whiten(spark.createDataFrame(line, TABLE)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == 1.0 and got[0]["identity_error"] < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [i * 1e13, (i % 3) * 1e12, 1.0], 0) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, TABLE.replace("float", "double"))).collect()
    x = [[int(v * 256) for v in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((20 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want and got[0]["identity_error"] < 1e-9
