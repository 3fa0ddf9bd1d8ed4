"""Whitening of embeddings by components of an exact integer covariance.

Vectors become integers, so their scatter matrix is exact whatever the order of the sums; its characteristic polynomial,
roots and null spaces come from ``exact_spectrum``. Only what is bounded by the dimension reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_spectrum
from .common import batched, discard, saved, table

COMPONENTS = 4
#: Rows whose products are added up at once, and the bits of a limb: sums of limb products stay below 2**53.
ROWS, LIMB = 4_096, 20
#: Bits of the parts in which sums travel.
PART = 40
_SCHEMA = "_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"


def grid(vector: str) -> Column:
    """The vector as integers, floor(256 c) each; null for a vector that is null or holds null or non-finite entries."""
    c = F.col(vector).cast("array<double>")
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(c, lambda x: F.floor(x * 256.0).cast("bigint") + 0))


def integer_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(_id, _x) of the rows with a vector of integers; ids may be null or repeat. Other columns are dropped here."""
    out = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).alias("_vector"))
    return out.select("_id", grid("_vector").alias("_x")).where(F.col("_x").isNotNull())


def dimension(vectors: DataFrame) -> int:
    """The length of most vectors, the larger of equally frequent ones; 0 without rows."""
    most = vectors.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x'x as Python numbers: products of limbs in floating point, none of whose sums can round."""
    limbs = []
    rest = x
    while len(limbs) < 3 and len(rest) and max(-int(rest.min()), int(rest.max())) >= 1 << LIMB:
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for k in range(0, len(x), ROWS):
                total += (a[k : k + ROWS].T @ b[k : k + ROWS]).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


@dataclass(frozen=True)
class Scatter:
    """n distinct vectors with sums per dimension and sums of products, all exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def centred(self) -> list[list[int]]:
        """n times the sums of centred products: n squared times the covariance."""
        d = range(len(self.sums))
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def scatter(vectors: DataFrame, d: int) -> Scatter:
    """Exact sums over all rows of ``_x``: a partial matrix per task, added up by cell; the driver gets d * d cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = _matrix(batch.column("_x"), d)
            total += _products(np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        rows = []
        for i in range(d + 1):
            for j in range(i + 1):
                value, part = int(total[i, j]), 0
                while value:
                    last = -(1 << 60) <= value < 1 << 60
                    rows.append((i, j, part, value if last else value & ((1 << PART) - 1)))
                    value, part = (0 if last else value >> PART), part + 1
        schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("v", pa.int64())])
        yield from batched(rows, schema)

    cells = vectors.select("_x").mapInArrow(run, "i int, j int, part int, v bigint")
    # Sums of up to 2**60 a task need more than 64 bits.
    added = cells.groupBy("i", "j", "part").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    whole = [[0] * (d + 1) for _ in range(d + 1)]
    for i, j, part, v in added.collect():
        whole[i][j] += int(v) << (PART * part)
    for i in range(d + 1):
        for j in range(i):
            whole[j][i] = whole[i][j]
    return Scatter(whole[d][d], whole[d][:d], [row[:d] for row in whole[:d]])


@dataclass(frozen=True)
class Components:
    """Rows of ``axes`` are unit eigenvectors; ``variance`` their eigenvalues, falling; ``explained`` shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray


def components(spark: SparkSession, of: Scatter, wanted: int = COMPONENTS) -> Components:
    """The first components with a positive eigenvalue, ``wanted`` at most; equal eigenvalues share an orthonormal basis."""
    d = len(of.sums)
    centred = of.centred() if of.n else []
    trace = sum(centred[i][i] for i in range(len(centred)))
    axes, values = [], []
    if trace:
        poly = exact_spectrum.characteristic_polynomial(spark, centred)
        rough = np.linalg.eigvalsh(np.array([[float(Fraction(x, trace)) for x in row] for row in centred]))
        guesses = [float(x) * float(trace) for x in rough[::-1][: wanted + 1]]
        for root, many in exact_spectrum.largest_roots(poly, wanted, guesses):
            many = min(many, wanted - len(values))
            axes.extend(exact_spectrum.null_space(centred, root, many))
            values.extend([root] * many)
    return Components(
        of.n, of.sums, np.array(axes).reshape(-1, d), np.array([float(v / of.n**2) for v in values]),
        np.array([float(v / trace) for v in values]),
    )


def _deviation(x: np.ndarray, found: Components) -> list[int | None]:
    """Exact sums of (n x - S)^2 per row; null where one does not fit into 64 bits."""
    sums, largest = found.sums, max((abs(s) for s in found.sums), default=0)
    reach = max(-int(x.min(initial=0)), int(x.max(initial=0))) * found.n + largest
    if reach**2 * x.shape[1] < 1 << 62:
        return ((x * found.n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((int(c) * found.n - s) ** 2 for c, s in zip(row, sums)) for row in x)
    return [v if v < 1 << 63 else None for v in exact]


def _projected(x: np.ndarray, found: Components) -> np.ndarray:
    centre = np.array([float(Fraction(s, found.n)) for s in found.sums])
    return (x.astype(np.float64) - centre) @ (found.axes / np.sqrt(found.variance)[:, None]).T


def whiten(vectors: DataFrame, found: Components) -> DataFrame:
    """(_id, component, n, deviation, whitened, explained): a row per vector and component, in one narrow pass."""
    d, m = found.axes.shape[1], len(found.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), d)
            of = pa.array(np.repeat(np.arange(len(x)), m))
            columns = [
                batch.column("_id").take(of), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * m, found.n)), pa.array(_deviation(x, found), pa.int64()).take(of),
                pa.array(_projected(x, found).ravel()), pa.array(np.tile(found.explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(run, _SCHEMA)


def identity_error(vectors: DataFrame, found: Components) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity; centred, divisor n."""
    d, m = found.axes.shape[1], len(found.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _projected(_matrix(batch.column("_x"), d), found)
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in y.T], [f"y{k}" for k in range(m)])

    y = vectors.select("_x").mapInArrow(run, ", ".join(f"y{k} double" for k in range(m)))
    pairs = [(i, j) for i in range(m) for j in range(i + 1)]
    covariance = y.agg(*[F.covar_pop(f"y{i}", f"y{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, covariance))


def whitened(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(_id, component, n, deviation, whitened, explained, identity_error) for every row with a usable vector.

    Rows whose vector is null or holds null or non-finite entries are left out, as are vectors of another length than most
    have. Every distinct vector counts once in the covariance, however many rows repeat it; each row is returned. A
    component without variance does not exist: fewer than ``wanted`` are returned then, and none (an empty result) if all
    vectors are equal or the table is empty.
    """
    every = integer_rows(rows, id_col, vector_col)
    d = dimension(every)
    mine = every.where(F.size("_x") == d)
    none = spark.createDataFrame([], _SCHEMA + ", identity_error double")
    if not d:
        return none
    fit = saved(mine.select("_x").distinct(), "distinct-vectors")
    found = components(spark, scatter(fit, d), wanted)
    error = identity_error(fit, found) if len(found.axes) else 0.0
    discard(fit)
    return whiten(mine, found).withColumn("identity_error", F.lit(error)) if len(found.axes) else none


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    out = whitened(spark, table(spark, sf_dir, "embeddings"))
    return out.select(F.col("_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
