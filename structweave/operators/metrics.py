"""Token-level evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_f1(predicted: DataFrame, outside: int) -> DataFrame:
    """F1 per tag weighted by support over all tags but ``outside``, from (tag, predicted) rows.

    One aggregate over the tokens leaves at most T² counts; the rest works on those.
    """
    return f1_of_counts(predicted.groupBy("tag", "predicted").agg(F.count(F.lit(1)).alias("n")), outside)


def f1_of_counts(pairs: DataFrame, outside: int, by: Sequence[str] = ()) -> DataFrame:
    """``weighted_f1`` from counts (by, tag, predicted, n), for each value of ``by``."""
    hit = F.when(F.col("tag") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = pairs.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("tag").alias("t"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"), hit.alias("hits")),
                F.struct(F.col("predicted").alias("t"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("hits")),
            )
        )
    )
    per_tag = (
        sides.where(F.col("t") != outside)
        .groupBy(*by, "t")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits"))
    )
    both = F.col("support") + F.col("claimed")
    f1 = F.when(both > 0, F.lit(2.0) * F.col("hits") / both).otherwise(F.lit(0.0))
    weighted = F.sum(f1 * F.col("support")) / F.sum("support")
    return per_tag.groupBy(*by).agg(F.when(F.sum("support") > 0, weighted).otherwise(F.lit(0.0)).alias("weighted_f1"))
