"""Whitening: polynomial and roots against known ones, results against a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from structweave.llm import exact_spectrum as e
from structweave.llm import whitening as w
from structweave.llm.common import table


def from_roots(*roots):
    poly = [1]
    for root in roots:
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    return poly


def determinant(matrix):
    """By expansion along the first row."""
    if not matrix:
        return 1
    rest = [row[1:] for row in matrix]
    return sum((-1) ** i * matrix[i][0] * determinant(rest[:i] + rest[i + 1 :]) for i in range(len(matrix)))


@pytest.mark.parametrize("d", [1, 2, 3, 4, 6])
def test_polynomial(spark, d):
    r = np.random.default_rng(d)
    b = r.integers(-10**6, 10**6, (d, max(1, d - 1)))
    matrix = [[int(x) for x in row] for row in b @ b.T]
    poly = e.characteristic_polynomial(spark, matrix)
    assert poly[-1] == 1
    for x in range(-1, d + 1):
        shifted = [[x * (i == j) - matrix[i][j] for j in range(d)] for i in range(d)]
        assert determinant(shifted) == sum(c * x**k for k, c in enumerate(poly))


def test_hessenberg_needs_exchanges():
    matrix = np.array([[0, 0, 1, 2], [0, 3, 0, 1], [5, 0, 0, 0], [1, 1, 0, 4]], np.int64)
    p = 101
    found = e.polynomial_modulo(matrix, p)
    for x in range(6):
        shifted = [[x * (i == j) - int(matrix[i][j]) for j in range(4)] for i in range(4)]
        assert (determinant(shifted) - sum(int(c) * x**k for k, c in enumerate(found))) % p == 0


def test_primes():
    first = [p for p, _ in zip(e.primes_below(1 << 31), range(20))]
    assert first[0] == 2**31 - 1 and all(all(p % q for q in range(2, 2_000)) for p in first)
    assert [p for p in e.primes_below(60) if p > 13] == [59, 53, 47, 43, 41, 37, 31, 29, 23, 19, 17]


def test_roots():
    poly = from_roots(5, 5, 9, 2, 0, 7)
    for guesses in ((), (9.0, 7.0, 5.0), (1e9, -4.0, 6.3)):
        found = e.largest_roots(poly, 5, guesses)
        assert [m for _, m in found] == [1, 1, 2, 1]
        assert all(abs(x - y) < Fraction(1, 1 << 180) for (x, _), y in zip(found, (9, 7, 5, 2)))
    # Roots that agree in 30 digits are told apart; the polynomial of 10**30 x.
    near = from_roots(10**30, 10**30 + 1, 3)
    assert [m for _, m in e.largest_roots(near, 3)] == [1, 1, 1]
    assert e.largest_roots(from_roots(0, 0, 0), 4) == []


def plain(vectors, wanted=4):
    """n, S, eigenvalues and axes over distinct integer vectors, by floating point."""
    x = np.unique(np.floor(256 * np.array(vectors, np.float64)), axis=0)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return len(x), x.sum(axis=0), values[::-1][:wanted], axes.T[::-1][:wanted], values.sum()


def held(rows, vectors, wanted=4):
    """Result rows against the definition."""
    n, sums, values, axes, trace = plain(list(vectors.values()), wanted)
    assert len(rows) == len(vectors) * len(values)
    signs = {}
    for row in rows:
        x = np.floor(256 * np.array(vectors[row.vec_id], np.float64))
        k = row.component - 1
        assert row.n == n and row.deviation == int(sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums)))
        expected = (x - sums / n) @ axes[k] / math.sqrt(values[k])
        if abs(expected) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(row.whitened * expected))
        assert abs(abs(row.whitened) - abs(expected)) < 1e-8 * (1 + abs(expected))
        assert abs(row.explained / (values[k] / trace) - 1) < 1e-9
        assert 0 <= row.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_query(spark, sf):
    rows = w.op12_whitening(spark, sf).collect()
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").collect()}
    held(rows, vectors)


def _frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, _x string, n double, component string")


def test_edges(spark, written):
    """Nulls, non-finite entries, other lengths, repeated rows and clashing names; copies count once."""
    r = np.random.default_rng(4)
    good = {k: [float(np.float32(x)) for x in r.normal(size=3)] for k in range(12)}
    good[12], good[13] = good[3], [-0.0, 0.0, 1e-30]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0], [float("-inf")] * 3]
    rows = [(k, v, "x", 0.5, "y") for k, v in good.items()] + [(100 + k, v, "x", 0.5, "y") for k, v in enumerate(bad)]
    path = written(embeddings=_frame(spark, rows + [(None, good[5], "x", 0.5, "y")]))
    found = w.op12_whitening(spark, path).collect()
    assert {row.vec_id for row in found} == {*good, None}
    held([row for row in found if row.vec_id is not None], good, 3)
    assert {row.component for row in found} == {1, 2, 3}
    for rows in ([], [(1, None, "", 0.0, "")], [(1, [1.0, 2.0], "", 0.0, ""), (2, [1.0, 2.0], "", 0.0, "")], [(1, [], "", 0.0, "")]):
        nothing = w.op12_whitening(spark, written(embeddings=_frame(spark, rows)))
        assert nothing.count() == 0 and len(nothing.columns) == 7


def test_equal_eigenvalues_and_lost_dimensions(spark, written):
    """The corners of a cube in the first three of five dimensions: one threefold eigenvalue, no fourth component."""
    corners = [[a, b, c, 3.0, 0.0] for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 1.0)]
    found = w.op12_whitening(spark, written(embeddings=_frame(spark, [(k, v, "", 0.0, "") for k, v in enumerate(corners)]))).collect()
    assert len(found) == 24 and all(abs(row.explained - 1 / 3) < 1e-12 and row.identity_error < 1e-12 for row in found)
    y = np.zeros((8, 3))
    for row in found:
        y[row.vec_id, row.component - 1] = row.whitened
    assert np.allclose(y.T @ y / 8, np.eye(3))


def test_large_numbers(spark):
    """Sums of products beyond 64 bits stay exact; a deviation beyond them is null."""
    x = [[(-1) ** k * (2**40 + k), 2**62 - k * 2**50, k] for k in range(9)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "_id bigint, _x array<bigint>").repartition(3)
    found = w.scatter(df, 3)
    assert found.n == 9 and found.sums == [sum(c) for c in zip(*x)]
    assert found.products == [[sum(v[i] * v[j] for v in x) for j in range(3)] for i in range(3)]
    rows = w.whiten(df, w.components(spark, found)).collect()
    assert len(rows) == 18 and all(row.deviation is None for row in rows)  # the last two dimensions lie on a line
    many = spark.range(3 * w.ROWS + 7).select(F.array((F.col("id") % 3 - 1) * (1 << 19), F.col("id")).alias("_x"))
    assert w.scatter(many, 2).products[1][1] == sum(k * k for k in range(3 * w.ROWS + 7))
