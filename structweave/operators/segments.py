"""Sequences as bounded segments.

A sequence row holds at most SEGMENT tokens plus two neighbours on each side (the reach of the feature
templates). Ordinary sequences are one segment; a sequence of any length becomes many rows, so no task
has to hold it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.templates import AFTER, BEFORE
from .ranking import stretches

SEGMENT = 4096
REACH = 2
ITEM = ("pos", "word", "pos_tag", "chunk", "tag")


def with_halo(tokens: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Add ``seg`` and repeat the tokens within REACH of a segment border in the neighbouring segment."""
    own = F.floor(F.col("pos") / F.lit(float(size))).cast("bigint")
    offset = F.pmod(F.col("pos"), F.lit(size))
    last = F.floor((F.col("len") - 1) / F.lit(float(size))).cast("bigint")
    before = F.when((offset < REACH) & (own > 0), own - 1)
    after = F.when((offset >= size - REACH) & (own < last), own + 1)
    return tokens.withColumn("seg", F.explode(F.array_compact(F.array(own, before, after))))


def _runs(tokens: DataFrame, same: Sequence[str]) -> DataFrame:
    """Token rows that follow each other and are equal in ``same`` as one row, their items as arrays."""
    fields = [f for f in tokens.select(*same, *ITEM).schema]
    schema = T.StructType([T.StructField(f.name, f.dataType if f.name in same else T.ArrayType(f.dataType)) for f in fields])

    def run(batches):
        for batch in batches:
            cuts = stretches(*(batch.column(c) for c in same))
            starts = pa.array([a for a, _ in cuts], pa.int64())
            offsets = pa.array([*(a for a, _ in cuts), batch.num_rows], pa.int32())
            kept = [batch.column(c).take(starts) for c in same]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ITEM)], schema.names)

    return tokens.select(*same, *ITEM).mapInArrow(run, schema)


def segments(tokens: DataFrame, keys: Sequence[str], size: int = SEGMENT, together: bool = False) -> DataFrame:
    """Assemble (keys, pos, len, word, pos_tag, chunk, tag) token rows into segment rows.

    Columns: keys, seg, len (tokens of the whole sequence), left (neighbours before the first own
    token), n (own tokens), and the arrays words, pos_tags, chunks, tags. Rows of an array are ordered by pos.

    ``together`` says that most tokens of a sequence still follow each other as they came from their text. They are
    then put together where they are, and are neither sorted nor shuffled one by one.
    """
    same = [*keys, "seg", "len"]
    halo = with_halo(tokens, size)
    if together:
        parts = _runs(halo, same).groupBy(*same).agg(F.collect_list(F.struct(*ITEM)).alias("_parts"))
        items = F.flatten(F.transform("_parts", lambda part: F.arrays_zip(*(part.getField(c).alias(c) for c in ITEM))))
        grouped = parts.select(*same, F.sort_array(items).alias("_items"))
    else:
        grouped = halo.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct(*ITEM))).alias("_items"))
    start = F.col("seg") * size
    return grouped.select(
        *keys,
        "seg",
        F.col("len").cast("bigint").alias("len"),
        (start - F.col("_items").getItem(0).getField("pos")).cast("int").alias("left"),
        F.least(F.col("len") - start, F.lit(size)).cast("int").alias("n"),
        *[
            F.col(f"_items.{field}").cast("array<bigint>").alias(out)
            for field, out in (("word", "words"), ("pos_tag", "pos_tags"), ("chunk", "chunks"), ("tag", "tags"))
        ],
    )


def own_tokens(segs: DataFrame, keys: Sequence[str], size: int = SEGMENT) -> DataFrame:
    """Back to token rows, neighbours dropped."""
    zipped = F.arrays_zip("words", "pos_tags", "chunks", "tags")
    return (
        segs.select(*keys, "seg", "len", "left", "n", F.posexplode(zipped).alias("_i", "_t"))
        .where((F.col("_i") >= F.col("left")) & (F.col("_i") < F.col("left") + F.col("n")))
        .select(
            *keys,
            (F.col("seg") * size + F.col("_i") - F.col("left")).alias("pos"),
            "len",
            F.col("_t.words").alias("word"),
            F.col("_t.pos_tags").alias("pos_tag"),
            F.col("_t.chunks").alias("chunk"),
            F.col("_t.tags").alias("tag"),
        )
    )


def context_window(tokens: DataFrame, keys: Sequence[str], size: int = SEGMENT) -> DataFrame:
    """Each token with its neighbours: the columns the feature templates read, plus y and y1.

    Windows run inside (keys, seg) with neighbours repeated, so a long sequence is split over tasks.
    """
    window = Window.partitionBy(*keys, "seg").orderBy("pos")

    def near(column: str, offset: int, missing: int | None):
        moved = F.lag(column, -offset).over(window) if offset < 0 else F.lead(column, offset).over(window)
        return moved if missing is None else F.coalesce(moved, F.lit(missing).cast("bigint"))

    cast = [F.col(c).cast("bigint").alias(c) for c in ("word", "pos_tag", "chunk", "tag")]
    halo = with_halo(tokens, size).select(*keys, "seg", "pos", "len", *cast)
    columns = {
        "w": F.col("word"), "w_m1": near("word", -1, BEFORE), "w_m2": near("word", -2, None),
        "w_n1": near("word", 1, AFTER), "w_n2": near("word", 2, None),
        "p": F.col("pos_tag"), "p_m1": near("pos_tag", -1, BEFORE), "p_n1": near("pos_tag", 1, AFTER),
        "c": F.col("chunk"), "c_m1": near("chunk", -1, BEFORE), "c_n1": near("chunk", 1, AFTER),
        "y": F.col("tag"), "y1": near("tag", -1, BEFORE),
    }
    framed = halo.select(*keys, "seg", "pos", "len", *[c.alias(n) for n, c in columns.items()])
    return framed.where(F.col("seg") == F.floor(F.col("pos") / F.lit(float(size)))).drop("seg")
