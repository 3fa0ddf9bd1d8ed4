"""What the operators share: reading inputs, written intermediates, bounded Arrow output, rows of a document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, saved  # noqa: F401  (for the operators)

#: A byte limit of one Arrow batch that a task emits; texts longer than this go alone.
EMIT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``_id``, ``_hash``, ``_text``): one row per input row, null texts as they are.

    ``_hash`` tells rows apart that share an id; rows equal in both are copies of one another. Other columns are dropped
    here, so their names cannot clash.
    """
    out = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return out.withColumn("_hash", F.xxhash64("_text"))


def crc32_of_id(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def batched(rows: Iterable[tuple], schema: pa.Schema, weigh=lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= EMIT_BYTES or len(held) >= 20_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
