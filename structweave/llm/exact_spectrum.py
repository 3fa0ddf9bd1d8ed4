"""Eigenpairs of an integer scatter matrix from its exact characteristic polynomial.

The polynomial is computed modulo many primes (Hessenberg reduction, as Spark tasks) and put together by Chinese
remaindering. A symmetric matrix has real roots only, so the sign changes of the shifted polynomial count the roots above a
point exactly: that isolates each root, which bisection by sign then narrows. Eigenvectors are the null space of
(matrix - root), found by inverse iteration in fixed-point numbers of many bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Relative accuracy of a root in bits; roots that agree so far count as one root of higher multiplicity.
ROOT_BITS = 192
#: Bits after the point in inverse iteration.
POINT = 480
Matrix = list[list[int]]


def primes_below(start: int) -> Iterator[int]:
    """Primes below ``start``, at most 2**31, downwards: Miller-Rabin with bases that are proven for such numbers."""
    for p in range(start - 1, 2, -1):
        if p % 2 and all(p % q for q in (3, 5, 7, 11, 13)) and all(_probable(p, a) for a in (2, 3, 5, 7)):
            yield p


def _probable(p: int, a: int) -> bool:
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    x = pow(a, d, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(s - 1))


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - matrix) modulo p < 2**31, constant first, by reduction to Hessenberg form."""
    h, d = matrix % p, len(matrix)
    for j in range(d - 2):
        pivots = np.flatnonzero(h[j + 1 :, j])
        if not len(pivots):
            continue
        k = j + 1 + int(pivots[0])
        if k != j + 1:
            h[[j + 1, k]] = h[[k, j + 1]]
            h[:, [j + 1, k]] = h[:, [k, j + 1]]
        factor = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - factor[:, None] * h[j + 1]) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * factor % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(d):
        # weight[i]: entry (i, k) times the product of the entries below the diagonal from i to k.
        weight, run = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weight[i] = int(h[i, k]) * run % p
            run = run * int(h[i, i - 1]) % p if i else run
        found[k + 1, 1:] = found[k, :-1]
        found[k + 1] = (found[k + 1] - (weight[:, None] * found[: k + 1] % p).sum(axis=0)) % p
    return found[d]


def characteristic_polynomial(spark: SparkSession, matrix: Matrix) -> list[int]:
    """Exact coefficients of det(xI - matrix), constant first, of an integer matrix without negative eigenvalues.

    The coefficients are elementary symmetric sums, at most C(d, k) (trace / d)^k. Primes are dealt to tasks; what a
    task sends back is a row of d + 1 residues per prime.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // d)
    bound = max(comb(d, k) * mean**k for k in range(d + 1))
    chosen, modulus = [], 1
    for p in primes_below(1 << 31):
        if modulus > bound:
            break
        chosen.append(p)
        modulus *= p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [chosen[k] for k in batch.column("id").to_pylist()]
            rows = [polynomial_modulo(np.array([[x % p for x in row] for row in matrix], np.int64), p).tolist() for p in mine]
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(rows, pa.list_(pa.int64()))], ["p", "residues"])

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism)
    residues = {r.p: r.residues for r in spark.range(0, len(chosen), 1, tasks).mapInArrow(run, "p bigint, residues array<bigint>").collect()}
    sums, modulus = [0] * (d + 1), 1
    for p in chosen:
        inverse = pow(modulus, -1, p)
        for k in range(d + 1):
            signed = residues[p][k] * (-1) ** (d - k)  # the sums themselves, none of them negative
            sums[k] += modulus * ((signed - sums[k]) * inverse % p)
        modulus *= p
    return [s * (-1) ** (d - k) for k, s in enumerate(sums)]


def roots_above(poly: list[int], at: Fraction) -> int:
    """How many roots (with multiplicity) of a polynomial with real roots only lie above ``at``.

    For such polynomials Descartes' rule is exact: it is the number of sign changes of the shifted polynomial.
    """
    d, down, up = len(poly) - 1, at.denominator, at.numerator
    c = [x * down ** (d - k) for k, x in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += up * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: Fraction) -> int:
    value, scale = 0, 1
    for x in reversed(poly):
        value, scale = value * at.numerator + x * scale, scale * at.denominator
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], wanted: int, guesses: list[float] = ()) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots until ``wanted`` are found, falling; relative error 2**-ROOT_BITS.

    Every bracket is proven by counting; guesses only say where to count first.
    """
    top = -Fraction(poly[-2]) + 1  # above the sum of the roots, none of which is negative
    counts: dict[Fraction, int] = {top: 0}

    def count(at: Fraction) -> int:
        if at not in counts:
            counts[at] = roots_above(poly, at)
        return counts[at]

    trials = (Fraction(g * (1 + e)) for g in guesses for e in (-1e-9, 1e-9))
    for at in (Fraction(0), *trials):
        if 0 <= at < top:
            count(at)
    out, done = [], 0
    while done < min(wanted, counts[Fraction(0)]):
        low = max(t for t, n in counts.items() if n > done)
        high = min(t for t, n in counts.items() if n <= done)
        while (high - low) * (1 << ROOT_BITS) > high:
            middle = (low + high) / 2
            if counts[low] == done + 1:  # a root alone: the sign tells on which side it lies
                counts[middle] = done + (_sign(poly, middle) == (-1) ** (done + 1))
            if count(middle) > done:
                low = middle
            else:
                high = middle
        out.append(((low + high) / 2, counts[low] - done))
        done = counts[low]
    return out


def null_space(matrix: Matrix, root: Fraction, many: int) -> np.ndarray:
    """``many`` orthonormal rows that span the eigenspace of ``root``, to double precision.

    Elimination with row exchanges on fixed-point numbers; a pivot that vanishes counts as the smallest number. The
    largest entry of a row is positive.
    """
    d, one = len(matrix), 1 << POINT
    size = max(sum(abs(x) for x in row) for row in matrix) or 1
    shift = [int((root / size) * one) if i == j else 0 for i in range(d) for j in range(d)]
    a = np.array([x * one // size for row in matrix for x in row], object).reshape(d, d) - np.array(shift, object).reshape(d, d)
    order, factors = [], []
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
        order.append(best)
        a[k, k] = a[k, k] or 1
        factors.append([(x << POINT) // a[k, k] for x in a[k + 1 :, k]])
        for i, f in enumerate(factors[-1], k + 1):
            if f:
                a[i, k:] -= (a[k, k:] * f) >> POINT

    def solve(b: list[int]) -> list[int]:
        b = list(b)
        for k in range(d):
            b[k], b[order[k]] = b[order[k]], b[k]
            for i, f in enumerate(factors[k], k + 1):
                b[i] -= (b[k] * f) >> POINT
        for k in range(d - 1, -1, -1):
            rest = b[k] - (sum(x * y for x, y in zip(a[k, k + 1 :], b[k + 1 :])) >> POINT)
            b[k] = (rest << POINT) // a[k, k]
        largest = max(map(abs, b)) or 1
        return [(x << POINT) // largest for x in b]

    basis: list[list[int]] = []
    for j in range(many):
        # Any start will do that is not orthogonal to the space.
        vector = [(pow(31, (i + 1) * (j + 2), 1_000_003) - 500_001) << (POINT - 20) for i in range(d)]
        for _ in range(3):
            vector = solve(_apart(vector, basis))
        basis.append(_unit(_apart(vector, basis)))
    out = np.array([[float(Fraction(x, one)) for x in row] for row in basis])
    return out * np.sign(np.take_along_axis(out, np.abs(out).argmax(axis=1)[:, None], axis=1))


def _apart(vector: list[int], basis: list[list[int]]) -> list[int]:
    """The part of the vector that is orthogonal to the basis; twice, against rounding."""
    for row in basis + basis:
        along = sum(x * y for x, y in zip(vector, row)) >> POINT
        vector = [x - ((along * y) >> POINT) for x, y in zip(vector, row)]
    return vector


def _unit(vector: list[int]) -> list[int]:
    norm = isqrt(sum(x * x for x in vector)) or 1
    return [(x << POINT) // norm for x in vector]
