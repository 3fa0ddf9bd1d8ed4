"""Exact numbering and running sums that never put a whole group, or a whole table, in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import MIX_MODULUS, drawn_rows, mix_hash, null_safe_join
from ..session import materialize

HASH_BUCKETS = 65536


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, out: str = "pos", total: str = "len"
) -> DataFrame:
    """Number rows 0.. inside each group by ``order`` and add the group's row count.

    ``slice_by`` must not decrease along ``order`` and must have few distinct values per group
    (hour of the day, say). Rows are ranked inside (group, slice), so a group that holds a third of the
    table is spread over its slices; the offsets between slices come from a pre-aggregated count.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    in_group = Window.partitionBy(*keys)
    before = in_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(
        *keys,
        "_slice",
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(in_group).alias(total),
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_local", F.row_number().over(local))
    # Null keys form groups too, so the offsets are matched null-safely.
    renamed = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_slice")], "_before", total)
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_slice")]
    number = (F.col("_before") + F.col("_local") - 1).cast("bigint")
    return ranked.join(renamed, reduce(Column.__and__, same)).select(*df.columns, number.alias(out), total)


def _range_scan(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition by ``order`` and materialize, so that the partition number of a row is a fact
    on disk and not something a second evaluation of the plan could choose differently."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return materialize(ranged)


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """Global running sums ``{out: column}`` along ``order`` (which must identify a row).

    One row per range partition carries the totals forward; the rows themselves are summed per
    partition. The broadcast side has one row per range partition.
    """
    scanned = _range_scan(df, order)
    totals = scanned.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    carried = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{o}").over(carried), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = scanned.select("*", *[F.sum(c).over(local).alias(f"_l_{o}") for o, c in sums.items()])
    joined = summed.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_o_{o}") + F.col(f"_l_{o}")).alias(o) for o in sums])


def global_index(df: DataFrame, order: Sequence[Column], out: str = "id", start: int = 0) -> DataFrame:
    """Dense global row number along ``order`` without a single-partition sort."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    summed = running_sums(ones, order, {out: "_one"})
    return summed.drop("_one").withColumn(out, F.col(out) + F.lit(start - 1).cast("bigint"))


def number_in_shards(
    df: DataFrame, shard: str, order: Sequence[Column], first: Column, partitions: int, out: str = "_row", total: str = "_size"
) -> DataFrame:
    """Number the examples of each shard 0.. along ``order`` and add how many the shard has.

    A row for which ``first`` holds opens an example; the rows after it belong to it. Rows are range-partitioned by (shard,
    order), so a shard is as many blocks as its size asks for; a block is numbered in one pass and carries on from a table of
    one row per (shard, partition). The result is placed and sorted like that.
    """
    opened = df.withColumn("_first", first.cast("int")).repartitionByRange(partitions, F.col(shard), *order)
    blocks = materialize(opened.sortWithinPartitions(shard, *order).withColumn("_part", F.spark_partition_id()))
    counts = blocks.groupBy(shard, "_part").agg(F.sum("_first").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(
        shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(shard)).alias(total),
    )
    placed = null_safe_join(blocks, F.broadcast(carried), [shard, "_part"])
    kept = [*df.columns, total]
    schema = T.StructType([*(placed.schema[c] for c in kept), T.StructField(out, T.LongType())])

    def run(batches):
        at, count = (), 0
        for batch in batches:
            shards, opens = batch.column(shard), np.asarray(batch.column("_first"), dtype=np.int64)
            start = np.asarray(batch.column("_before"), dtype=np.int64)
            number = np.empty(len(shards), dtype=np.int64)
            for a, b in stretches(shards):
                if (found := shards[a].as_py()) != at:
                    at, count = found, 0
                number[a:b] = start[a] + count + np.cumsum(opens[a:b]) - 1
                count += int(opens[a:b].sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(number)], [*kept, out])

    return placed.mapInArrow(run, schema)


class ShardDraws:
    """Which steps of sampling with replacement draw a row, found where the row is: the inverse of ``drawn_rows``.

    The draws of one shard are held at a time, 16 bytes a row of the shard.
    """

    def __init__(self, stream: int):
        self.stream, self.shard = stream, None
        self.steps = self.bounds = np.zeros(0, dtype=np.int64)

    def of(self, shard: int, size: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``rows``, step) of all draws that hit these rows of a shard of ``size`` rows, row after row."""
        if shard != self.shard:
            drawn = drawn_rows(size, self.stream + shard)
            self.shard, self.steps = shard, np.argsort(drawn, kind="stable")
            self.bounds = np.concatenate([[0], np.cumsum(np.bincount(drawn, minlength=size))])
        times = self.bounds[rows + 1] - self.bounds[rows]
        at = np.repeat(np.arange(len(rows)), times)
        within = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        return at, self.steps[self.bounds[rows[at]] + within]


def draw_counts(df: DataFrame, row: str, total: str, stream: int, out: str = "n_draws") -> DataFrame:
    """Add how often each row, numbered 0.. in ``row`` of ``total``, is drawn in ``total`` draws with replacement.

    Rows are counted in place: nothing is joined or shuffled.
    """
    schema = T.StructType([*df.schema, T.StructField(out, T.LongType())])

    def run(batches):
        draws = ShardDraws(stream)
        for batch in batches:
            number = np.asarray(batch.column(row), dtype=np.int64)
            size = batch.column(total)[0].as_py() if batch.num_rows else 0
            at, _ = draws.of(0, size, number) if batch.num_rows else (number, number)
            times = np.bincount(at, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(times)], schema.names)

    return df.mapInArrow(run, schema)


def stretches(*columns: pa.Array | np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of rows that are equal in all columns; null equals null."""
    changed = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for values in columns:
        if isinstance(values, pa.Array):
            values = np.asarray(values.dictionary_encode(null_encoding="encode").indices)
        changed |= np.diff(values) != 0
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(columns[0])]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _hash_buckets(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    width = MIX_MODULUS // HASH_BUCKETS + 1
    # A null key has a hash too: its rows are ranked and split like any other.
    hashed = df.withColumn("_h", F.coalesce(mix_hash(F.col(key), seed), F.lit(0))).withColumn(
        "_bucket", F.floor(F.col("_h") / F.lit(float(width))).cast("int")
    )
    # At most HASH_BUCKETS rows: small enough for one task and for a broadcast, whatever the table size.
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = counts.select(
        "_bucket",
        F.col("_n"),
        F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )
    return hashed, offsets


def hash_rank(df: DataFrame, key: str, seed: int, out: str = "rank", total: str | None = None) -> DataFrame:
    """Dense rank 0.. of rows shuffled by an arithmetic hash of a unique integer ``key``, and how many there are."""
    hashed, offsets = _hash_buckets(df, key, seed)
    local = Window.partitionBy("_bucket").orderBy("_h", key)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_before") + F.row_number().over(local) - 1)
        .select(*df.columns, out, *([F.col("_total").alias(total)] if total else []))
    )


def hash_split(df: DataFrame, key: str, seed: int = 1, parts: tuple[int, int] = (3, 4)) -> DataFrame:
    """Deterministic shuffle split: the first floor(parts[0] * n / parts[1]) rows are ``train``.

    Only the one hash bucket that the cut falls into is ranked; all other rows are decided by their
    bucket alone and are never shuffled.
    """
    hashed, offsets = _hash_buckets(df, key, seed)
    cut = F.floor(F.col("_total") * parts[0] / F.lit(float(parts[1]))).cast("bigint")
    placed = hashed.join(F.broadcast(offsets.withColumn("_cut", cut)), "_bucket")
    whole_train = F.col("_before") + F.col("_n") <= F.col("_cut")
    whole_val = F.col("_before") >= F.col("_cut")
    sure = placed.where(whole_train | whole_val).withColumn("split", F.when(whole_train, "train").otherwise("val"))
    local = Window.partitionBy("_bucket").orderBy("_h", key)
    edge = (
        placed.where(~(whole_train | whole_val))
        .withColumn("_rank", F.col("_before") + F.row_number().over(local) - 1)
        .withColumn("split", F.when(F.col("_rank") < F.col("_cut"), "train").otherwise("val"))
    )
    columns = [*df.columns, "split"]
    return sure.select(*columns).unionAll(edge.select(*columns))


def hash_cut(df: DataFrame, key: str, seed: int = 1, parts: tuple[int, int] = (3, 4)) -> tuple[int, int | None] | None:
    """Where ``hash_split`` cuts: hash and key of the first row of the second part, None if that part is empty.

    With it a split is an expression on the key (``before_cut``), also on tables that repeat the keys. The driver sees the
    counts of HASH_BUCKETS buckets and this one row.
    """
    hashed, _ = _hash_buckets(df.select(key), key, seed)
    counts = dict(map(tuple, hashed.groupBy("_bucket").agg(F.count(F.lit(1))).collect()))
    rest = sum(counts.values()) * parts[0] // parts[1]
    for bucket in sorted(counts):
        if rest < counts[bucket]:
            found = hashed.where(F.col("_bucket") == bucket).orderBy("_h", key).offset(rest).limit(1).first()
            return found["_h"], found[key]
        rest -= counts[bucket]
    return None


def before_cut(key: Column, seed: int, cut: tuple[int, int | None] | None) -> Column:
    """Whether a row belongs to the first part of the split that ``cut`` describes."""
    if cut is None:
        return F.lit(True)
    h = F.coalesce(mix_hash(key, seed), F.lit(0))
    lower = F.lit(False) if cut[1] is None else F.coalesce(key < F.lit(cut[1]), F.lit(True))
    return (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & lower)
