"""Scoring, selection, losses and gradients of candidate groups.

A candidate row is (group_id, cand, iou, feats): ``cand`` is any orderable value (a number or a struct)
that fixes the order of candidates inside a group. Best-of-group is a partial aggregate and top-K is a
window limit, both of which shrink a group before the shuffle, so a hot group stays spread over the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decoding
from ..functions.columns import UNROLL_DIM, dot
from ..session import materialize
from .ranking import number_in_shards, running_sums, stretches
from .sequences import sum_vectors

GOLD_IOU = 0.5  # fixed value: relevance and accuracy threshold
MAX_CANDIDATES = 1000  # fixed value: candidates kept per group at load time, and cells per group in the AP


# Largest limit that Catalyst applies before the shuffle by default (windowGroupLimitThreshold).
NATIVE_LIMIT = 1000
SALTS = 64
CHUNK = 4096  # candidates of a group that are packed into one row
LANES = 64  # parts in which the best of a group are merged before they meet
FEW_GROUPS = 100_000  # ids of so many groups are broadcast, 8 bytes each

_BEST = "point int, group_id bigint, gold boolean, aug double, iou double, nth bigint, feats array<double>"


def _limit_per_group(df: DataFrame, order: Sequence[F.Column], limit: int, rank: str) -> DataFrame:
    """The first ``limit`` rows of each group along ``order``, numbered 1.. in ``rank``.

    Up to NATIVE_LIMIT Catalyst limits each group before the shuffle (WindowGroupLimit) as well as after it.
    Beyond, groups are first limited in salted parts, so that a hot group is never ranked in one task whole.
    """
    if limit > NATIVE_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64("cand"), F.lit(SALTS)))
        part = Window.partitionBy("group_id", "_salt").orderBy(*order)
        df = salted.withColumn("_nth", F.row_number().over(part)).where(F.col("_nth") <= limit).drop("_salt", "_nth")
    window = Window.partitionBy("group_id").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def truncate(df: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The first ``limit`` candidates of each group in stored order, with their number ``cand_id``."""
    ranked = _limit_per_group(df, [F.col("cand").asc()], limit, "cand_id")
    return ranked.withColumn("cand_id", F.col("cand_id") - 1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Array column of fixed length as an (n, dim) matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def score(df: DataFrame, w: Sequence[float], keep_feats: bool = True) -> DataFrame:
    """Add ``score`` = feats · w and ``aug`` = score + (1 - iou).

    Narrow vectors are multiplied inside generated code, wide ones by BLAS on Arrow batches; without
    ``keep_feats`` these do not travel back.
    """
    if len(w) <= UNROLL_DIM:
        scored = df.withColumn("score", dot(F.col("feats"), w))
    else:
        model = np.asarray(w, dtype=np.float64)
        dim = len(model)

        def run(batches):
            for batch in batches:
                scores = matrix(batch.column("feats"), dim) @ model
                columns = [*(batch.column(c) for c in kept), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "score"])

        kept = [c for c in df.columns if keep_feats or c != "feats"]
        schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
        scored = df.mapInArrow(run, schema)
    return scored.withColumn("aug", F.col("score") + (F.lit(1.0) - F.col("iou")))


def relevant(df: DataFrame) -> DataFrame:
    """Relevance label: iou > 0.5, strictly."""
    return df.withColumn("relevant", F.col("iou") > GOLD_IOU)



def _first_by(columns: Sequence[str], value: str) -> F.Column:
    """The row that has the highest ``value``, and among those the smallest ``cand``."""
    payload = columns[0] if len(columns) == 1 else F.struct(*columns)
    return F.min_by(payload, F.struct((-F.col(value)).alias("v"), F.col("cand").alias("c")))


def gold(df: DataFrame, columns: Sequence[str] = ("cand", "iou")) -> DataFrame:
    """The candidate with the highest iou of each group, first on ties."""
    best = df.groupBy("group_id").agg(_first_by(list(columns), "iou").alias("_g"))
    if len(columns) == 1:
        return best.withColumnRenamed("_g", columns[0])
    return best.select("group_id", "_g.*")


def argmax(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """The candidate with the highest ``by`` of each group, first on ties."""
    best = df.groupBy("group_id").agg(_first_by(list(columns), by).alias("_g"))
    return best.select("group_id", "_g.*")


def predict(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Predicted candidate per group: argmax of the raw score, with its iou."""
    return argmax(score(df, w, False), "score", ("cand", "iou", "score"))


def hinge(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Structural hinge per group: best augmented score minus that of the gold candidate."""
    best = score(df, w, False).groupBy("group_id").agg(F.max("aug").alias("_best"), _first_by(["aug"], "iou").alias("_gold"))
    return best.select("group_id", (F.col("_best") - F.col("_gold")).alias("hinge"))


def top_k(df: DataFrame, k: int, by: str = "aug") -> DataFrame:
    """The K best candidates of each group with ``rank`` 1.., fewer when the group is smaller."""
    return _limit_per_group(df, [F.col(by).desc(), F.col("cand").asc()], k, "rank")


def simplex_weights(ranked: DataFrame, mu: float, keys: Sequence[str] = ("group_id",), by: str = "aug") -> DataFrame:
    """Add ``weight``: projection of the descending scores of each group, divided by ``mu``, onto the simplex.

    Input groups hold at most K rows (see ``top_k``).
    """
    group = Window.partitionBy(*keys)
    order = group.orderBy("rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranked.withColumn("_sum", F.sum(by).over(upto)).withColumn("_next", F.lead(by).over(order))
    stops = F.col("_next").isNull() | (F.col("_sum") - F.col("rank") * F.col("_next") >= F.lit(float(mu)))
    rho = (F.lit(1.0) - F.col("_sum") / F.lit(float(mu))) / F.col("rank")
    first_stop = F.min(F.when(stops, F.struct(F.col("rank").alias("r"), rho.alias("rho")))).over(group)
    weight = F.greatest(F.lit(0.0), F.col(by) / F.lit(float(mu)) + first_stop.getField("rho"))
    return summed.withColumn("weight", weight).drop("_sum", "_next")


def smoothed_hinge(df: DataFrame, w: Sequence[float], mu: float, k: int) -> DataFrame:
    """Per group: ``hinge`` on the top K, and ``smooth`` = Σ u_k s_k minus the gold score."""
    scored = score(df, w, False)
    weighted = simplex_weights(top_k(scored.select("group_id", "cand", "aug"), k), mu)
    best = weighted.groupBy("group_id").agg(
        F.max("aug").alias("_best"), F.sum(F.col("weight") * F.col("aug")).alias("_smooth")
    )
    reference = gold(scored, ("aug",)).select(F.col("group_id").alias("_group"), F.col("aug").alias("_gold"))
    return best.join(reference, F.col("group_id").eqNullSafe(F.col("_group"))).select(
        "group_id",
        (F.col("_best") - F.col("_gold")).alias("hinge"),
        (F.col("_smooth") - F.col("_gold")).alias("smooth"),
    )


def weighted_feature_sum(df: DataFrame, weight: str, dim: int, feats: str = "feats") -> DataFrame:
    """Σ weight · feats over all rows as (idx, value)."""
    narrow = df.select(F.col(weight).cast("double").alias("_u"), F.col(feats).alias("_x"))
    if dim <= 16:
        sums = [F.sum(F.col("_u") * F.col("_x").getItem(j).cast("double")) for j in range(dim)]
        row = narrow.agg(F.array(*sums).alias("_s"))
        return row.select(F.posexplode("_s").alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("_u"), dtype=np.float64) @ matrix(batch.column("_x"), dim)

    return sum_vectors(narrow, dim, partial)


def _signed(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.select("weight", "feats").unionAll(negative.select(F.lit(-1.0).alias("weight"), "feats"))


def subgradient_sum(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Σ over groups of feats[argmax] - feats[gold]: (idx, value). One aggregate finds both rows."""
    pair = score(df, w).groupBy("group_id").agg(
        _first_by(["feats"], "aug").alias("_top"), _first_by(["feats"], "iou").alias("_gold")
    )
    both = pair.select(
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("weight"), F.col("_top").alias("feats")),
                F.struct(F.lit(-1.0).alias("weight"), F.col("_gold").alias("feats")),
            )
        )
    )
    return weighted_feature_sum(both, "weight", len(w))


def smoothed_gradient_sum(df: DataFrame, w: Sequence[float], mu: float, k: int) -> DataFrame:
    """Σ over groups of Σ u_k feats_k - feats[gold]: (idx, value)."""
    weighted = simplex_weights(top_k(score(df, w), k), mu).where(F.col("weight") > 0)
    reference = gold(df, ("feats",))
    return weighted_feature_sum(_signed(weighted, reference), "weight", len(w))


def linear_minimizers(df: DataFrame, w: Sequence[float]) -> DataFrame:
    """Per group (psi, loss): feats[gold] - feats[best] and 1 - iou[best], best by augmented score."""
    pair = score(df, w).groupBy("group_id").agg(
        _first_by(["feats", "iou"], "aug").alias("_top"), _first_by(["feats"], "iou").alias("_gold")
    )
    psi = F.zip_with("_gold", F.col("_top.feats"), lambda g, t: g.cast("double") - t.cast("double"))
    return pair.select("group_id", psi.alias("psi"), (F.lit(1.0) - F.col("_top.iou")).alias("loss"))


def pack(df: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, bool]:
    """(group_id, chunk, chunks, ious, feats) written once, candidates in order; and whether any group has several rows.

    Groups of up to ``chunk`` candidates are gathered into a row. The rows of a larger one are range-partitioned by
    candidate and numbered, so no task gathers more than ``chunk`` of them.
    """
    item = F.struct("cand", "iou", "feats")

    def rows(parts: DataFrame, keys: Sequence[str], number: F.Column, of: F.Column) -> DataFrame:
        grouped = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_c"))
        return grouped.select(
            "group_id", number.cast("bigint").alias("chunk"), of.cast("bigint").alias("chunks"),
            F.col("_c.iou").alias("ious"), F.flatten("_c.feats").alias("feats"),
        )

    sizes = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    large = materialize(sizes.select(F.col("group_id").alias("_g")))
    n_large = large.count()
    if not n_large:
        return materialize(rows(df, ["group_id"], F.lit(0), F.lit(1))), False
    large = F.broadcast(large) if n_large <= FEW_GROUPS else large
    same = F.col("group_id").eqNullSafe(F.col("_g"))
    small = rows(df.join(large, same, "left_anti"), ["group_id"], F.lit(0), F.lit(1))
    wide = df.join(large, same, "left_semi")
    tasks = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    numbered = number_in_shards(wide, "group_id", [F.col("cand")], F.lit(True), tasks, "_nth", "_n")
    cut = numbered.withColumn("_chunk", F.floor(F.col("_nth") / F.lit(float(chunk)))).withColumn("_of", F.ceil(F.col("_n") / F.lit(float(chunk))))
    return materialize(small.unionByName(rows(cut, ["group_id", "_chunk", "_of"], F.col("_chunk"), F.col("_of")))), True


class Best:
    """What counts of a candidate group, merged row by row: its K best by (augmented) score, its gold candidate.

    Ties go to the first in order. At most K + 1 feature vectors are held.
    """

    def __init__(self, w: np.ndarray, k: int, mu: float | None = None, use_loss: bool = True):
        self.w, self.k, self.mu, self.use_loss = w, k, mu, use_loss
        self.seen = 0
        self.top = self.top_iou = np.zeros(0)
        self.top_nth, self.top_feats = np.zeros(0, dtype=np.int64), np.zeros((0, 0))
        self.gold: tuple[float, int, float, np.ndarray] | None = None  # iou, number, score, feats

    def there(self, examples) -> None:
        """The group's next row, as loaded."""
        feats, ious, _ = examples
        self.add(feats, ious, self.seen + np.arange(len(ious)))
        self.seen += len(ious)

    def add(self, feats: np.ndarray, ious: np.ndarray, nth: np.ndarray) -> None:
        score = feats @ self.w + (1 - ious if self.use_loss else 0.0)
        at = np.lexsort((nth, -score))[: self.k]
        g = np.lexsort((nth, -ious))[0]
        self.merge(score[at], ious[at], nth[at], feats[at], (float(ious[g]), int(nth[g]), float(score[g]), feats[g]))

    def merge(self, top, iou, nth, feats, gold) -> None:
        if len(self.top):
            top, iou, nth = (np.concatenate(pair) for pair in ((self.top, top), (self.top_iou, iou), (self.top_nth, nth)))
            feats = np.concatenate([self.top_feats, feats])
        at = np.lexsort((nth, -top))[: self.k]
        self.top, self.top_iou, self.top_nth, self.top_feats = top[at], iou[at], nth[at], feats[at]
        if gold is not None and (self.gold is None or (-gold[0], gold[1]) < (-self.gold[0], self.gold[1])):
            self.gold = gold

    def hinge(self) -> float:
        return float(self.top[0] - self.gold[2])

    def gradient(self, mu: float | None) -> np.ndarray:
        weights = np.ones(1) if mu is None else decoding.simplex_weights(self.top[None, :], mu)[0]
        return weights @ self.top_feats[: len(weights)] - self.gold[3]

    def rows(self, point: int, group: int | None) -> list[tuple]:
        found = [(point, group, False, *row) for row in zip(self.top.tolist(), self.top_iou.tolist(), self.top_nth.tolist(), self.top_feats)]
        iou, nth, score, feats = self.gold
        return [*found, (point, group, True, score, iou, nth, feats)]


def _best_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("point", pa.int32()), ("group_id", pa.int64()), ("gold", pa.bool_()), ("aug", pa.float64()), ("iou", pa.float64()), ("nth", pa.int64()), ("feats", pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def _take(best: Best, part: pa.RecordBatch) -> None:
    gold = np.asarray(part.column("gold"))
    aug, iou, nth = (np.asarray(part.column(c)) for c in ("aug", "iou", "nth"))
    feats = np.asarray(part.column("feats").flatten()).reshape(len(gold), -1)
    found = np.flatnonzero(gold)
    first = found[np.lexsort((nth[found], -iou[found]))[:1]]
    one = (float(iou[first[0]]), int(nth[first[0]]), float(aug[first[0]]), feats[first[0]]) if len(first) else None
    best.merge(aug[~gold], iou[~gold], nth[~gold], feats[~gold], one)


def merged_best(rows: DataFrame, points: Sequence[np.ndarray], k: int, finish: Callable, schema: str, use_loss: bool = True) -> DataFrame:
    """What ``finish`` makes of (point, group, Best) of every packed group at several models, as Arrow batches.

    A task merges the rows of a group that it reads; what is left meets in LANES parts of a group, then per group, row after
    row, so no task holds more than K + 1 candidates of a group.
    """
    dim = len(points[0])

    def read(batches):
        held: tuple = (None, [])
        for batch in batches:
            groups, chunks, sizes = (batch.column(c).to_pylist() for c in ("group_id", "chunk", "chunks"))
            for i, group in enumerate(groups):
                if held[1] and held[0] != (group,):
                    yield _best_batch([row for p, best in enumerate(held[1]) for row in best.rows(p, held[0][0])])
                    held = (None, [])
                if not held[1]:
                    held = ((group,), [Best(w, k, None, use_loss) for w in points])
                ious = np.asarray(batch.column("ious")[i].values, dtype=np.float64)
                feats = np.asarray(batch.column("feats")[i].values, dtype=np.float64).reshape(-1, dim)
                # Chunks are numbered, and a number says where a chunk starts relative to the others.
                nth = (chunks[i] << 32) + np.arange(len(ious))
                for best in held[1]:
                    best.add(feats, ious, nth)
        if held[1]:
            yield _best_batch([row for p, best in enumerate(held[1]) for row in best.rows(p, held[0][0])])

    def merge(batches):
        key, best = None, None
        for batch in batches:
            point, group = batch.column("point"), batch.column("group_id")
            for a, b in stretches(point, group):
                now = (point[a].as_py(), group[a].as_py())
                if now != key:
                    if best is not None:
                        yield *key, best
                    key, best = now, Best(np.zeros(0), k)
                _take(best, batch.slice(a, b - a))
        if best is not None:
            yield *key, best

    def partly(batches):
        return (_best_batch(best.rows(point, group)) for point, group, best in merge(batches))

    found = rows.select("group_id", "chunk", "chunks", "ious", "feats").mapInArrow(read, _BEST)
    lane = F.pmod(F.spark_partition_id(), F.lit(LANES))
    dealt = found.withColumn("_lane", lane).repartition("point", "group_id", "_lane").sortWithinPartitions("point", "group_id", "_lane").drop("_lane")
    parts = dealt.mapInArrow(partly, _BEST)
    met = parts.repartition("point", "group_id").sortWithinPartitions("point", "group_id")
    return met.mapInArrow(lambda batches: finish(merge(batches)), schema)


def mean_iou(predicted: DataFrame) -> DataFrame:
    """Mean iou of the predicted candidates."""
    return predicted.agg(F.avg("iou").alias("mean_iou"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """Share of groups whose predicted candidate has iou >= 0.5, inclusively."""
    return predicted.agg(F.avg((F.col("iou") >= GOLD_IOU).cast("double")).alias("accuracy"))


def micro_average_precision(scored: DataFrame, pad_to: int | None = MAX_CANDIDATES) -> DataFrame:
    """Average precision over all (group, candidate) cells with label iou > 0.5.

    Groups are padded to ``pad_to`` cells of score 0 and label 0, added as one counted row. Cells with the
    same score share a threshold, so scores are counted first; the running totals over the distinct scores
    are range-partitioned.
    """
    cells = scored.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("iou") > GOLD_IOU).cast("bigint")).alias("hits")
    )
    if pad_to is not None:
        sizes = scored.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
        missing = F.sum(F.greatest(F.lit(pad_to) - F.col("_n"), F.lit(0)))
        padding = sizes.agg(missing.alias("n")).select(
            F.lit(0.0).alias("score"), "n", F.lit(0).cast("bigint").alias("hits")
        )
        cells = cells.unionByName(padding).groupBy("score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    totals = running_sums(cells, [F.col("score").desc()], {"seen": "n", "found": "hits"})
    return totals.agg(
        (F.sum(F.col("hits") * F.col("found") / F.col("seen")) / F.sum("hits")).alias("average_precision")
    )
