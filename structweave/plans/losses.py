"""Losses over tables: what the trainer needs from a task, as Arrow-batch kernels over persisted rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions import decoding
from ..functions.columns import mix_hash
from ..functions.spans import SpannedGradient
from ..operators import binary, candidates, metrics, sequences
from ..operators.candidates import Best
from ..operators.ranking import ShardDraws, number_in_shards, stretches
from ..operators.segments import SEGMENT
from ..session import materialize, spread


SHARDS = 8  # fewest parts of a table whose inner epochs are averaged
SHARD_ROWS = 1 << 17  # examples that a part has about, in tables with more than SHARDS times as many


class Kernel:
    """Per-batch mathematics of a loss. Subclass it to plug in a loss of your own.

    ``load`` turns an Arrow batch into any examples object; ``values`` gives the plain and the smoothed
    loss per example; ``gradient_sum`` a vector of length ``dim``. ``mu`` is the smoothing coefficient, None
    for the plain loss; a kernel without smoothing ignores it.
    """

    dim: int
    weigh: str | None = None  # array column whose lengths tell how much a row weighs
    sparse = False  # whether ``example_rows`` and ``support_rows`` give gradients as (idx, value)
    parts = 1  # vectors of ``gradient_parts``

    def load(self, batch: pa.RecordBatch):
        raise NotImplementedError

    def size(self, examples) -> int:
        raise NotImplementedError

    def take(self, examples, i: int):
        raise NotImplementedError

    def values(self, examples, w: np.ndarray, mu: float | None) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def gradient_sum(self, examples, w: np.ndarray, mu: float | None) -> np.ndarray:
        raise NotImplementedError

    def gradient_parts(self, examples, w: np.ndarray, mu: float | None) -> np.ndarray:
        """``gradient_sum`` as ``parts`` vectors one after the other that add up to it, each without rounding errors where
        a kernel has more than one."""
        return self.gradient_sum(examples, w, mu)

    def example_gradient(self, examples, i: int, w: np.ndarray, mu: float | None) -> np.ndarray:
        return self.gradient_sum(self.take(examples, i), w, mu)

    def support(self, examples, w: np.ndarray, mu: float | None):
        """Gradients at a fixed point, asked for example by example."""
        return lambda i: self.example_gradient(examples, i, w, mu)

    def spans(self, batch: pa.RecordBatch) -> np.ndarray | None:
        """How many rows each row's example is spread over; None if all are one row."""
        return None

    def spanned(self, w, mu: float | None):
        """Collects the gradient of an example that is spread over rows: ``there`` takes its rows in order, ``back`` takes
        them again from last to first if ``returns``."""
        raise NotImplementedError

    returns = False


class LogisticKernel(Kernel):
    """Logistic loss on (feats, y)."""

    def __init__(self, dim: int):
        self.dim = dim

    def load(self, batch):
        return candidates.matrix(batch.column("feats"), self.dim), np.asarray(batch.column("y"), dtype=np.float64)

    def size(self, examples):
        return len(examples[1])

    def take(self, examples, i):
        return examples[0][i : i + 1], examples[1][i : i + 1]

    def values(self, examples, w, mu):
        x, y = examples
        z = x @ w
        loss = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z
        return loss, loss

    def _residual(self, examples, w, mu):
        """What each row's features are weighted by in its gradient; all that another loss of a linear score changes."""
        return binary.stable_sigmoid(examples[0] @ w) - examples[1]

    def gradient_sum(self, examples, w, mu):
        return self._residual(examples, w, mu) @ examples[0]

    def support(self, examples, w, mu):
        residual = self._residual(examples, w, mu)
        return lambda i: residual[i] * examples[0][i]


class CandidateKernel(Kernel):
    """Structural hinge on packed groups (ious, flat feats)."""

    weigh = "feats"

    def __init__(self, dim: int, k: int):
        self.dim, self.k = dim, k

    def load(self, batch):
        size = np.asarray(pc.list_value_length(batch.column("ious")), dtype=np.int64)
        ious = np.asarray(batch.column("ious").flatten(), dtype=np.float64)
        return candidates.matrix(batch.column("feats"), self.dim), ious, np.concatenate([[0], np.cumsum(size)])

    def size(self, examples):
        return len(examples[2]) - 1

    def take(self, examples, i):
        feats, ious, bounds = examples
        a, b = bounds[i], bounds[i + 1]
        return feats[a:b], ious[a:b], np.array([0, b - a])

    @staticmethod
    def firsts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Index of the highest value of each group, first on ties."""
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        top = np.flatnonzero(values == np.maximum.reduceat(values, bounds[:-1])[owner])
        return top[np.unique(owner[top], return_index=True)[1]]

    def _choose(self, examples, w, mu):
        """Per group the top candidates (groups, K) with weights and scores, and the gold candidate."""
        feats, ious, bounds = examples
        aug = feats @ w + (1 - ious)
        gold = self.firsts(ious, bounds)
        if mu is None:
            best = self.firsts(aug, bounds)[:, None]
            return best, np.ones(best.shape), aug[best], gold, aug[gold]
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((-aug, owner))
        rank = np.arange(len(aug)) - bounds[owner]
        kept = rank < self.k
        best = np.zeros((len(size), self.k), dtype=np.int64)
        scores = np.full(best.shape, decoding.MISSING)
        best[owner[kept], rank[kept]] = order[kept]
        scores[owner[kept], rank[kept]] = aug[order[kept]]
        return best, decoding.simplex_weights(scores, mu), scores, gold, aug[gold]

    def values(self, examples, w, mu):
        _, weights, scores, _, reference = self._choose(examples, w, mu)
        smooth = (weights * np.where(np.isfinite(scores), scores, 0.0)).sum(axis=1)
        return scores[:, 0] - reference, smooth - reference

    def gradient_sum(self, examples, w, mu):
        best, weights, _, gold, _ = self._choose(examples, w, mu)
        feats = examples[0]
        spread = np.bincount(best.ravel(), weights=weights.ravel(), minlength=len(feats))
        spread[gold] -= 1
        return spread @ feats

    def example_gradient(self, examples, i, w, mu):
        feats, ious, bounds = examples
        part = slice(bounds[i], bounds[i + 1])
        x, iou = feats[part], ious[part]
        aug = x @ w + (1 - iou)
        gold = x[np.argmax(iou)]
        if mu is None:
            return x[np.argmax(aug)] - gold
        best = np.argsort(-aug, kind="stable")[: self.k]
        return np.array(decoding.mixture(aug[best].tolist(), mu)) @ x[best] - gold

    def support(self, examples, w, mu):
        feats = examples[0]
        best, weights, _, gold, _ = self._choose(examples, w, mu)
        return lambda i: weights[i] @ feats[best[i]] - feats[gold[i]]

    def spans(self, batch):
        return np.asarray(batch.column("chunks"), dtype=np.int64)

    def spanned(self, w, mu):
        return Best(w, 1 if mu is None else self.k, mu)


class SequenceKernel(Kernel):
    """Structural hinge with Hamming loss on segments of sequences."""

    weigh = "words"
    sparse = True
    parts = 2
    returns = True

    def __init__(self, dim: int, n_tags: int, k: int, size: int = SEGMENT):
        self.dim, self.n_tags, self.k, self.segment = dim, n_tags, k, size

    def load(self, batch):
        return decoding.token_batch(batch)

    def size(self, examples):
        return len(examples.size)

    def take(self, examples, i):
        return examples.one(i)

    def _k(self, mu):
        return 1 if mu is None else self.k

    def values(self, examples, w, mu):
        return sequences._values(examples, w, self.n_tags, mu, self._k(mu))

    def gradient_sum(self, examples, w, mu):
        return sequences.batch_gradient(examples, w, self.n_tags, mu, self._k(mu))

    def gradient_parts(self, examples, w, mu):
        return sequences.batch_gradient(examples, w, self.n_tags, mu, self._k(mu), True)

    def support(self, examples, w, mu):
        rows = self.support_rows(examples, w, mu)

        def at(i):
            out = np.zeros(self.dim)
            idx, value = rows(i)
            out[idx] = value
            return out

        return at

    def example_rows(self, examples, i, w, mu):
        """The gradient of one example as (idx, value); ``w`` may be anything that is read by index."""
        if examples.ahead is None or i not in examples.ahead:
            examples.ahead = decoding.Ahead(examples, i, self.dim, self.n_tags)
        return examples.ahead.gradient(i, w, mu, self._k(mu))

    def support_rows(self, examples, w, mu):
        row, idx, value = sequences.gradient_rows(examples, w, self.n_tags, mu, self._k(mu))
        bounds = np.searchsorted(row, np.arange(len(examples.size) + 1))
        return lambda i: (idx[bounds[i] : bounds[i + 1]], value[bounds[i] : bounds[i + 1]])

    def spans(self, batch):
        length = np.asarray(batch.column("len"), dtype=np.int64)
        return np.maximum(-(-length // self.segment), 1)

    def spanned(self, w, mu):
        return SpannedGradient(w, self.n_tags, mu, self.k)


class TableLoss:
    """A loss over a persisted table, cut into buckets by an arithmetic hash of the example key.

    ``n_buckets`` fixes the minibatches: bucket b of a pass is one minibatch, and a pass visits every
    row once. Rows are placed and ordered by (bucket, key), so every task sees the same rows in the
    same order when it runs again elsewhere.
    """

    supports_lmo = False

    def __init__(self, df: DataFrame, keys: Sequence[str], kernel: Kernel, key_hash: Column | None = None):
        self.source, self.keys, self.kernel = df, tuple(keys), kernel
        # Examples with a null key are examples like any other.
        self._key_hash = F.coalesce(key_hash if key_hash is not None else F.xxhash64(*keys), F.lit(0))
        self.df: DataFrame | None = None
        self.n = 0
        self.n_buckets = 1
        self.partitions = 0
        self.numbered = False
        # What an example is dealt to a shard by, and which of its rows is the first.
        self._shard_by: list[Column] = [F.col(k) for k in keys]
        self._opens = F.lit(True)

    def prepare(self, partitions: int | None = None, n_buckets: int = 1, numbered: bool = True):
        """Persist the rows; with ``numbered``, which inner epochs need, also place and number them within shards.

        ``partitions`` is the number of shards, the parts whose inner epochs are averaged: SHARDS, and more in tables of
        over SHARDS * SHARD_ROWS examples. It is part of the algorithm and follows from the table alone, so the same call
        gives the same model on any cluster. Where rows are stored is another matter: they keep the partitions of their
        source (one per core at least), and a shard is spread over as many of them as it fills.
        """
        if self.df is not None and self.n_buckets == n_buckets and partitions in (None, self.partitions) and (self.numbered or not numbered):
            return self
        self.release()
        self.n = self.n or self.source.count()
        self.partitions = partitions or max(SHARDS, -(-self.n // SHARD_ROWS))
        self.n_buckets, self.numbered = n_buckets, numbered
        rows = self.source.withColumn("_bucket", F.pmod(self._key_hash, F.lit(n_buckets)).cast("int"))
        if numbered:
            shard = F.pmod(F.xxhash64(*self._shard_by), F.lit(self.partitions)).cast("int")
            tasks = max(self.source.rdd.getNumPartitions(), self.source.sparkSession.sparkContext.defaultParallelism)
            order = [F.col(k) for k in self.keys]
            rows = number_in_shards(rows.withColumn("_shard", shard), "_shard", order, self._opens, tasks)
            ordered = rows if n_buckets == 1 else rows.sortWithinPartitions("_bucket", "_shard", *self.keys)
        else:
            ordered = spread(rows, *self.keys).sortWithinPartitions("_bucket", *self.keys)
        self.df = ordered.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def drawn(self, seed: int, epoch: int) -> DataFrame:
        """Rows in the order in which an inner epoch draws them: uniformly with replacement within each shard, as many
        draws as examples. A row stands as often as it is drawn; a partition holds whole shards, in order of their steps.

        Which steps draw a row follows from its number and the size of its shard, so rows are multiplied where they are
        stored and only what is drawn moves, once. A task holds the draws of one shard, 16 bytes an example. The rows
        of an example that is spread over rows come in order, and once more from last to first if the kernel asks for it
        (``_order``).
        """
        kernel, rows, nth = self.kernel, self.rows(), self.keys[-1]
        dropped = ("_bucket", "_size", "_row")
        kept = [f for f in rows.schema if f.name not in dropped]
        schema = T.StructType([*kept, T.StructField("_step", T.LongType()), T.StructField("_order", T.LongType())])

        def run(batches):
            draws = ShardDraws(seed * 1_000_003 + epoch * 1_009)
            for batch in batches:
                for a, b in stretches(batch.column("_shard")):
                    part = batch.slice(a, b - a)
                    at, step = draws.of(part.column("_shard")[0].as_py(), part.column("_size")[0].as_py(), np.asarray(part.column("_row")))
                    order = np.zeros(len(at), dtype=np.int64)
                    spans = kernel.spans(part)
                    if spans is not None and (spans[at] > 1).any():
                        order = np.asarray(part.column(nth), dtype=np.int64)[at]
                        twice = np.flatnonzero(spans[at] > 1) if kernel.returns else np.zeros(0, dtype=np.int64)
                        order = np.concatenate([order, 2 * spans[at[twice]] - 1 - order[twice]])
                        at, step = np.concatenate([at, at[twice]]), np.concatenate([step, step[twice]])
                    moved = part.take(pa.array(at))
                    columns = [*(moved.column(f.name) for f in kept), pa.array(step), pa.array(order)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        lanes = min(self.partitions, max(SHARDS, 2 * rows.sparkSession.sparkContext.defaultParallelism))
        found = rows.mapInArrow(run, schema).repartitionById(lanes, F.col("_shard") % lanes)
        return found.sortWithinPartitions("_shard", "_step", "_order")

    def release(self):
        if self.df is not None:
            self.df.unpersist()
            self.df = None

    def rows(self, bucket: int | None = None) -> DataFrame:
        """All rows, or one bucket; sorted cache batches without the bucket are skipped."""
        self.prepare(self.partitions or None, self.n_buckets, self.numbered)
        return self.df if bucket is None else self.df.where(F.col("_bucket") == bucket)

    def gradient_means(self, points: Sequence[tuple[np.ndarray, float | None]], bucket: int | None = None) -> np.ndarray:
        """Mean gradients at several (w, mu) in one job; one partial sum per task, then by index."""
        kernel, dim, m, parts = self.kernel, self.kernel.dim, len(points), self.kernel.parts

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            examples = kernel.load(batch)
            sums = [kernel.gradient_parts(examples, w, mu) for w, mu in points]
            return np.concatenate([*sums, [kernel.size(examples)]])

        sums = sequences.sum_vectors(self.rows(bucket), m * parts * dim + 1, partial, kernel.weigh)
        return self._means(sums, m, dim, parts)

    @staticmethod
    def _means(sums: DataFrame, m: int, dim: int, parts: int = 1) -> np.ndarray:
        flat = np.zeros(m * parts * dim + 1)
        table = sums.toArrow()
        flat[np.asarray(table["idx"])] = np.asarray(table["value"])
        return flat[:-1].reshape(m, parts, dim).sum(axis=1) / max(flat[-1], 1.0)

    def value_means(self, points: Sequence[np.ndarray]) -> np.ndarray:
        """Mean plain loss at several w in one job."""
        kernel, m = self.kernel, len(points)

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            examples = kernel.load(batch)
            sums = [kernel.values(examples, w, None)[0].sum() for w in points]
            return np.array([*sums, kernel.size(examples)])

        return self._means(sequences.sum_vectors(self.rows(), m + 1, partial, kernel.weigh), m, 1)[:, 0]

    def metrics(self, w: np.ndarray) -> dict[str, float]:
        """Evaluation metrics; a loss may have none."""
        return {}

    def metrics_many(self, points: Sequence[np.ndarray]) -> list[dict[str, float]]:
        """Metrics at several models; losses that can, count for all of them in one job."""
        return [self.metrics(w) for w in points]

    def linear_minimizers(self, w: np.ndarray, bucket: int) -> DataFrame:
        """(keys, idx array, val array, loss) of one bucket, for losses that support it."""
        raise TypeError(f"{type(self).__name__} has no linear minimisation")


class LogisticLoss(TableLoss):
    """Logistic loss on (id, feats, y)."""

    def __init__(self, df: DataFrame, dim: int):
        super().__init__(df.select("id", "feats", "y"), ("id",), LogisticKernel(dim), mix_hash(F.col("id")))

    def metrics(self, w):
        return self.metrics_many([w])[0]

    def metrics_many(self, points):
        kernel, m = self.kernel, len(points)

        def misses(batch: pa.RecordBatch) -> np.ndarray:
            x, y = kernel.load(batch)
            return np.array([*(np.abs((1 + np.sign(x @ w)) / 2 - y).sum() for w in points), len(y)])

        sums = sequences.sum_vectors(self.rows(), m + 1, misses, kernel.weigh)
        return [{"error": float(e)} for e in self._means(sums, m, 1)[:, 0]]


class CandidateLoss(TableLoss):
    """Structural hinge on candidate rows (group_id, cand, iou, feats).

    A group is packed into one row, after which every pass is narrow. One of more than ``chunk`` candidates is cut into
    rows of so many; what counts of it, its best candidates and the gold one, is merged over its rows, so a group of any
    size trains whole. ``limit`` keeps the first so many of each group. ``pad_to``: cells per group in the average precision.
    """

    supports_lmo = True

    def __init__(
        self, df: DataFrame, dim: int, k: int = 10, limit: int | None = None, pad_to: int = candidates.MAX_CANDIDATES, chunk: int = candidates.CHUNK,
    ):
        kept = df if limit is None else candidates.truncate(df, limit)
        # Packing is the expensive part of loading, so it is written once and read by every later pass.
        packed, has_long = candidates.pack(kept.select("group_id", "cand", "iou", "feats"), chunk)
        self._set(packed, has_long, dim, k, limit or pad_to)

    @classmethod
    def of_packed(cls, packed: DataFrame, has_long: bool, dim: int, k: int = 10, limit: int | None = None, pad_to: int = candidates.MAX_CANDIDATES):
        """A loss over rows of ``candidates.pack``, or some of its groups."""
        loss = cls.__new__(cls)
        loss._set(packed, has_long, dim, k, limit or pad_to)
        return loss

    def _set(self, packed: DataFrame, has_long: bool, dim: int, k: int, pad_to: int) -> None:
        TableLoss.__init__(self, packed, ("group_id", "chunk"), CandidateKernel(dim, k), mix_hash(F.col("group_id")))
        self.has_long, self.pad_to = has_long, pad_to
        self._shard_by = [F.col("group_id")]
        self._opens = F.col("chunk") == 0
        if has_long:
            self.n = packed.where("chunk = 0").count()

    def _one_row(self, bucket: int | None = None) -> DataFrame:
        rows = self.rows(bucket)
        return rows.where("chunks = 1") if self.has_long else rows

    def _merged(self, points: Sequence[np.ndarray], k: int, bucket: int | None, finish, schema: str, use_loss: bool = True) -> DataFrame:
        return candidates.merged_best(self.rows(bucket).where("chunks > 1"), points, k, finish, schema, use_loss)

    def _part_sums(self, points, bucket, width, one, long) -> np.ndarray:
        """Sums of vectors of ``width`` per point over all groups, divided by the number of groups."""
        kernel, m = self.kernel, len(points)

        def narrow(batch: pa.RecordBatch) -> np.ndarray:
            examples = kernel.load(batch)
            return np.concatenate([*(one(examples, *point) for point in points), [kernel.size(examples)]])

        def wide(found):
            total = np.zeros(m * width + 1)
            for at, _, best in found:
                total[at * width : (at + 1) * width] += long(best, points[at][1])
                total[-1] += at == 0
            index = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[index])], ["idx", "value"])

        sums = sequences.sum_vectors(self._one_row(bucket), m * width + 1, narrow, kernel.weigh)
        if self.has_long:
            k = kernel.k if any(mu is not None for _, mu in points) else 1
            merged = self._merged([w for w, _ in points], k, bucket, wide, "idx bigint, value double")
            sums = sums.unionByName(merged).groupBy("idx").agg(F.sum("value").alias("value"))
        return self._means(sums, m, width)

    def gradient_means(self, points, bucket=None):
        if not self.has_long:
            return super().gradient_means(points, bucket)
        return self._part_sums(points, bucket, self.kernel.dim, self.kernel.gradient_sum, lambda best, mu: best.gradient(mu))

    def value_means(self, points):
        if not self.has_long:
            return super().value_means(points)
        kernel = self.kernel
        one = lambda examples, w, mu: [kernel.values(examples, w, None)[0].sum()]
        return self._part_sums([(w, None) for w in points], None, 1, one, lambda best, mu: best.hinge())[:, 0]

    def cells(self, w: np.ndarray) -> DataFrame:
        """Scored candidates (group_id, iou, score, best): ``best`` marks the first with the highest score of its row."""
        kernel = self.kernel

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            feats, ious, bounds = kernel.load(batch)
            scores = feats @ w
            best = np.zeros(len(scores), dtype=bool)
            best[kernel.firsts(scores, bounds)] = True
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            rows = batch.take(pa.array(owner))
            columns = [rows.column("group_id"), rows.column("chunks"), pa.array(ious), pa.array(scores), pa.array(best)]
            return pa.RecordBatch.from_arrays(columns, ["group_id", "chunks", "iou", "score", "best"])

        return sequences.map_arrow(self.rows(), "group_id bigint, chunks bigint, iou double, score double, best boolean", run, "feats")

    def metrics(self, w):
        cells = self.cells(w)
        predicted = cells.where("best and chunks = 1").select("iou")
        if self.has_long:

            def best_iou(found):
                yield pa.RecordBatch.from_arrays([pa.array([best.top_iou[0] for _, _, best in found], pa.float64())], ["iou"])

            predicted = predicted.unionAll(self._merged([w], 1, None, best_iou, "iou double", False))
        best = predicted.agg(
            F.avg("iou").alias("mean_iou"),
            F.avg((F.col("iou") >= candidates.GOLD_IOU).cast("double")).alias("accuracy"),
        )
        precision = candidates.micro_average_precision(cells, self.pad_to)
        return {**best.first().asDict(), **precision.first().asDict()}

    def linear_minimizers(self, w, bucket):
        kernel, dim = self.kernel, self.kernel.dim
        names = ["group_id", "chunk", "idx", "val", "loss"]

        def dense(group: pa.Array, psi: np.ndarray, loss: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.arange(len(psi) + 1) * dim, pa.int32())
            index = pa.ListArray.from_arrays(offsets, pa.array(np.tile(np.arange(dim), len(psi))))
            first = pa.array(np.zeros(len(psi), dtype=np.int64))
            return pa.RecordBatch.from_arrays([group, first, index, pa.ListArray.from_arrays(offsets, pa.array(psi.ravel())), pa.array(loss)], names)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            examples = kernel.load(batch)
            feats, ious, _ = examples
            best, _, _, gold, _ = kernel._choose(examples, w, None)
            best = best[:, 0]
            return dense(batch.column("group_id"), feats[gold] - feats[best], 1 - ious[best])

        def merged(found):
            for _, group, best in found:
                yield dense(pa.array([group], pa.int64()), -best.gradient(None)[None, :], np.array([1 - best.top_iou[0]]))

        schema = "group_id bigint, chunk bigint, idx array<bigint>, val array<double>, loss double"
        minima = sequences.map_arrow(self._one_row(bucket), schema, run, "feats")
        if not self.has_long:
            return minima
        return minima.unionByName(self._merged([w], 1, bucket, merged, schema))


class SequenceLoss(TableLoss):
    """Structural hinge on a sequence table. A sequence longer than a segment is one example: batch gradients and values
    decode it as a tree of segments, inner epochs segment by segment within its step."""

    supports_lmo = True

    def __init__(self, table: sequences.SequenceTable, dim: int, k: int = 5, outside: int = 0):
        self.table, self.k, self.outside = table, k, outside
        super().__init__(table.df, (*table.keys, "seg"), SequenceKernel(dim, table.n_tags, k, table.size), F.xxhash64(*table.keys))
        self._shard_by = [*(F.col(key) for key in table.keys), F.lit(0).cast("bigint")]
        self._opens = F.col("seg") == 0
        self.has_long = table.has_long
        if self.has_long:
            self.n = table.df.where(F.col("seg") == 0).count()

    def _part(self, bucket: int | None) -> sequences.SequenceTable:
        t = self.table
        return sequences.SequenceTable(self.rows(bucket), t.keys, t.n_tags, t.size, t.has_long)

    def gradient_means(self, points, bucket=None):
        if not self.has_long:
            return super().gradient_means(points, bucket)
        part, dim = self._part(bucket), self.kernel.dim
        n = self.n if bucket is None else part.df.where(F.col("seg") == 0).count()
        out = np.zeros((len(points), 2 * dim))
        for row, (w, mu) in enumerate(points):
            found = sequences.gradient_sum(part, w, mu, self.k, True).toArrow()
            out[row, np.asarray(found["idx"])] = np.asarray(found["value"])
        return out.reshape(-1, 2, dim).sum(axis=1) / max(n, 1)

    def value_means(self, points):
        if not self.has_long:
            return super().value_means(points)
        part = self._part(None)
        return np.array([sequences.sequence_values(part, w).agg(F.avg("hinge")).first()[0] for w in points])

    def metrics(self, w):
        predicted = sequences.predict_tags(self._part(None), w)
        return metrics.weighted_f1(predicted, self.outside).first().asDict()

    def metrics_many(self, points):
        if self.has_long:
            return super().metrics_many(points)
        counted = metrics.f1_of_counts(sequences.confusion(self._part(None), points), self.outside, ("run",)).collect()
        found = {r["run"]: r["weighted_f1"] for r in counted}
        return [{"weighted_f1": found.get(k, 0.0)} for k in range(len(points))]

    def linear_minimizers(self, w, bucket):
        return sequences.linear_minimizers(self._part(bucket), w)


