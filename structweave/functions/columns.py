"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Widest vector for which scores and sums are written out term by term (whole-stage codegen);
# beyond it the Arrow kernels take over.
UNROLL_DIM = 64

# Modulus and multipliers of the mixing hash (two Lehmer steps modulo 2^31 - 1).
MIX_MODULUS = 2147483647
MIX_FIRST = 48271
MIX_SECOND = 69621
MIX_SEED = 7919


def dot(feats: Column, w: Sequence[float]) -> Column:
    """Inner product of an array column with a fixed vector, terms added left to right."""
    total = feats.getItem(0).cast("double") * F.lit(float(w[0]))
    for j in range(1, len(w)):
        total = total + feats.getItem(j).cast("double") * F.lit(float(w[j]))
    return total


def mix_hash(key: Column, seed: Column | int = 0) -> Column:
    """Arithmetic hash of an integer key to [0, 2^31 - 1), the same in any SQL engine."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    modulus = F.lit(MIX_MODULUS).cast("bigint")
    start = F.pmod(F.pmod(key.cast("bigint"), modulus) + F.pmod(seed.cast("bigint"), modulus) * MIX_SEED, modulus)
    first = F.pmod(start * MIX_FIRST, modulus)
    folded = F.pmod(first + F.floor(first / F.lit(65536.0)).cast("bigint"), modulus)
    return F.pmod(folded * MIX_SECOND, modulus)


def drawn_rows(size: int, seed: int) -> np.ndarray:
    """The row, of ``size`` numbered from 0, that each step of sampling with replacement draws: ``mix_hash`` of the step."""
    start = (np.arange(size, dtype=np.int64) % MIX_MODULUS + seed % MIX_MODULUS * MIX_SEED) % MIX_MODULUS
    first = start * MIX_FIRST % MIX_MODULUS
    return (first + first // 65536) % MIX_MODULUS * MIX_SECOND % MIX_MODULUS % max(size, 1)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name; null keys match null keys, and the keys of ``left`` stay."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [left[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_k_{k}" for k in keys])


def round9(value: Column) -> Column:
    """Round to nine digits and drop the sign of zero."""
    return F.round(value, 9) + F.lit(0.0)


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow for either sign of ``z``."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))
