"""Logistic loss on dense examples (id, feats, y) with y in {0, 1}, and the l2 penalty."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import UNROLL_DIM, dot, sigmoid
from .candidates import matrix, weighted_feature_sum
from .sequences import sum_vectors


def score(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Add the margin ``z`` = feats · w."""
    if len(w) <= UNROLL_DIM:
        return df.withColumn("z", dot(F.col("feats"), w))
    model = np.asarray(w, dtype=np.float64)
    dim = len(model)

    def run(batches):
        for batch in batches:
            margins = matrix(batch.column("feats"), dim) @ model
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margins)], [*batch.schema.names, "z"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("z", T.DoubleType())]))


def losses(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Add ``loss`` = -(y ln p + (1 - y) ln(1 - p)) in the form that cannot overflow."""
    z, y = F.col("z"), F.col("y")
    return score(df, w).withColumn("loss", F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)


def residuals(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Add ``residual`` = p - y."""
    return score(df, w).withColumn("residual", sigmoid(F.col("z")) - F.col("y"))


def stable_sigmoid(z: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, small) / (1.0 + small)


def gradient_sum(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Σ (p - y) feats over all rows: (idx, value)."""
    dim = len(w)
    if dim <= 16:
        return weighted_feature_sum(residuals(df, w), "residual", dim)
    model = np.asarray(w, dtype=np.float64)

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("feats"), dim)
        y = np.asarray(batch.column("y"), dtype=np.float64)
        return (stable_sigmoid(x @ model) - y) @ x

    return sum_vectors(df.select("feats", "y"), dim, partial)


def error(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """0-1 error; a margin of exactly 0 counts one half."""
    miss = F.abs((F.lit(1.0) + F.signum("z")) / F.lit(2.0) - F.col("y"))
    return score(df, w).agg(F.avg(miss).alias("error"))


def l2_penalty(weights: DataFrame, strength: float, centre: DataFrame | None = None) -> DataFrame:
    """strength / 2 · ‖w - centre‖² of a weight table (idx, w), with ``centre`` (idx, w) or the origin."""
    offset = F.col("w")
    table = weights
    if centre is not None:
        table = weights.join(centre.select("idx", F.col("w").alias("_c")), "idx", "left")
        offset = F.col("w") - F.coalesce("_c", F.lit(0.0))
    return table.agg((F.lit(strength / 2.0) * F.sum(offset * offset)).alias("penalty"))


def gradient_norm(gradient: DataFrame) -> DataFrame:
    """Euclidean norm of a gradient table (idx, value)."""
    return gradient.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def with_target(df: DataFrame, column: str, positive, out: str = "y") -> DataFrame:
    """0/1 target: ``column`` equals ``positive``."""
    return df.withColumn(out, (F.col(column) == F.lit(positive)).cast("double"))
