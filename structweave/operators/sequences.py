"""Decoding, losses and gradients of tagged sequences.

Everything runs on segment rows (see ``segments``) through Arrow batches: one narrow pass, no shuffle
but the one that adds gradients up by index. Sequences longer than a segment take the exact detour of
``long_sequences``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decoding as kernel
from ..functions.columns import null_safe_join
from ..session import materialize
from .segments import SEGMENT, own_tokens, segments

PIECE = "rank int, score double, entry bigint, path array<bigint>"
# How much a kernel works on at a time: tokens of sequences, feature values of packed candidates.
SLICE = {"words": 100_000, "feats": 16_000_000}
COARSE, FINE = 2.0**22, 2.0**48


def slices(batches: Iterator[pa.RecordBatch], weigh: str | None = None) -> Iterator[pa.RecordBatch]:
    """Non-empty batches, cut so that the lengths of array column ``weigh`` add up to about its SLICE."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if weigh is None:
            yield batch
            continue
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(weigh)), dtype=np.int64))
        cuts = np.flatnonzero(np.diff(ends // SLICE[weigh])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


@dataclass(frozen=True)
class SequenceTable:
    """Encoded sequences: segment rows, the key columns, the number of tags, and whether any is long."""

    df: DataFrame
    keys: tuple[str, ...]
    n_tags: int
    size: int = SEGMENT
    has_long: bool = False

    @classmethod
    def from_tokens(cls, tokens: DataFrame, keys: Sequence[str], n_tags: int, size: int = SEGMENT) -> SequenceTable:
        """Assemble token rows once, write the result to the shared folder and note long sequences.

        Empty sequences have no token rows, so they cannot occur here.
        """
        table = materialize(segments(tokens, keys, size))
        return cls(table, tuple(keys), n_tags, size, bool(table.where(F.col("seg") > 0).head(1)))

    @property
    def whole(self) -> DataFrame:
        """Sequences that fit one segment."""
        return self.df.where(F.col("len") <= self.size) if self.has_long else self.df

    @property
    def long(self) -> DataFrame:
        return self.df.where(F.col("len") > self.size)

    @property
    def tokens(self) -> DataFrame:
        return own_tokens(self.df, self.keys, self.size)

    def key_fields(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.select(*self.keys).schema)


def map_arrow(
    df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch], weigh: str | None = None
) -> DataFrame:
    """Apply ``fn`` to every Arrow batch, in slices when ``weigh`` names an array column."""
    return df.mapInArrow(lambda batches: map(fn, slices(batches, weigh)), schema)


def exact_parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of about 1 as a coarse and a fine part, multiples of 2^-22 and of 2^-48, that give them to within 2^-49.

    Sums of either part are exact (of coarse ones up to 2^31, of fine ones up to 2^5, which takes 2^28 values), so they are
    the same however rows are dealt to batches and tasks.
    """
    coarse = np.rint(values * COARSE) / COARSE
    return coarse, np.rint((values - coarse) * FINE) / FINE


def weighted_counts(indices: np.ndarray, weights: np.ndarray, dim: int, exact: bool = False) -> np.ndarray:
    """How often an index stands in rows of indices that have a weight each; ``exact``: coarse counts, then fine ones."""
    parts = exact_parts(weights) if exact else (weights,)
    return np.concatenate([np.bincount(indices.ravel(), np.repeat(part, indices.shape[1]), minlength=dim) for part in parts])


def sum_vectors(
    df: DataFrame, dim: int, fn: Callable[[pa.RecordBatch], np.ndarray], weigh: str | None = None
) -> DataFrame:
    """Add up vectors of length ``dim`` over all rows: one partial vector per task, then by index: (idx, value)."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(dim)
        for batch in slices(batches, weigh):
            total += fn(batch)
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(total[index])], ["idx", "value"])

    partial = df.mapInArrow(run, "idx bigint, value double")
    return partial.groupBy("idx").agg(F.sum("value").alias("value"))


def _record(batch: pa.RecordBatch, keys: Sequence[str], rows: np.ndarray | None, **columns) -> pa.RecordBatch:
    taken = [batch.column(k) if rows is None else batch.column(k).take(pa.array(rows)) for k in keys]
    values = [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays([*taken, *values], [*keys, *columns])


def _ragged(values: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def edge_scores(table: SequenceTable, w: np.ndarray, use_loss: bool = False) -> DataFrame:
    """Score of every (previous tag, tag) pair at every position: (keys, pos, y1, y, score).

    With ``use_loss`` a tag that differs from the recorded one gains 1.
    """
    keys, n_tags, size = table.keys, table.n_tags, table.size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        node, arrive, link = kernel.potentials(tb.context, tb.has, w, n_tags)
        if use_loss:
            node = node + (np.arange(n_tags)[None, :] != tb.tags[:, None])
        own, owner = tb.own, tb.owner
        seg = np.asarray(batch.column("seg"))
        pos = seg[owner] * size + own - tb.first[owner]
        scores = node[own][:, None, :] + arrive[own][:, :, None] + link[None]
        previous = np.arange(-1, n_tags)
        valid = (previous[None, :] == -1) == (pos[:, None] == 0)
        token, y1 = np.nonzero(valid)
        out = scores[token, y1]
        rows = np.repeat(owner[token], n_tags)
        return _record(
            batch, keys, rows,
            pos=np.repeat(pos[token], n_tags), y1=np.repeat(previous[y1], n_tags).astype(np.int64),
            y=np.tile(np.arange(n_tags, dtype=np.int64), len(token)), score=out.ravel(),
        )

    return map_arrow(table.df, f"{table.key_fields()}, pos bigint, y1 bigint, y bigint, score double", run, "words")


def k_largest(edges: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The K largest cells of the (y1, y) table of each key, with ``rank`` 1..; ties in index order."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "y1", "y")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def feature_counts(table: SequenceTable, dim: int) -> DataFrame:
    """Feature vector of each sequence under its own tagging, in sparse rows (keys, idx, n)."""
    keys = table.keys

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        cell = (tb.owner[:, None] * dim + kernel.gold_indices(tb, dim)).ravel()
        cells, n = np.unique(cell, return_counts=True)
        return _record(batch, keys, cells // dim, idx=cells % dim, n=n)

    counts = map_arrow(table.df, f"{table.key_fields()}, idx bigint, n bigint", run, "words")
    return counts.groupBy(*keys, "idx").agg(F.sum("n").alias("n")) if table.has_long else counts


def sequence_score(table: SequenceTable, w: np.ndarray) -> DataFrame:
    """Score of each sequence under its own tagging: (keys, score)."""
    keys = table.keys

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        return _record(batch, keys, None, score=kernel.path_scores(tb, kernel.gold_indices(tb, len(w)), w))

    scores = map_arrow(table.df, f"{table.key_fields()}, score double", run, "words")
    return scores.groupBy(*keys).agg(F.sum("score").alias("score")) if table.has_long else scores


def decode(table: SequenceTable, w: np.ndarray, k: int = 1, use_loss: bool = False) -> DataFrame:
    """K best taggings of every sequence: (keys, seg, rank, score, entry, path).

    ``score`` belongs to the whole sequence, ``path`` to the segment and ``entry`` is the tag before it
    (-1 at the start). Equal scores are ordered by the path read backwards. A sequence with fewer than
    K taggings has fewer rows.
    """
    keys, n_tags = table.keys, table.n_tags

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        lattice = kernel.forward(tb, w, n_tags, k, use_loss, np.full(len(tb.size), -1))
        scores, tags, ranks = kernel.best_ends(lattice, k)
        rows, rank = np.nonzero(np.isfinite(scores))
        flat = lattice.paths(rows, tags[rows, rank], ranks[rows, rank])
        return _record(
            batch, (*keys, "seg"), rows,
            rank=(rank + 1).astype(np.int32), score=scores[rows, rank],
            entry=np.full(len(rows), -1, dtype=np.int64), path=_ragged(flat, tb.size[rows]),
        )

    whole = map_arrow(table.whole, f"{table.key_fields()}, seg bigint, {PIECE}", run, "words")
    if not table.has_long:
        return whole
    from .long_sequences import decode_long

    return whole.unionByName(decode_long(table, w, k, use_loss))


def predict_tags(table: SequenceTable, w: np.ndarray) -> DataFrame:
    """Predicted tag of every token, decoded without the loss term: (keys, pos, tag, predicted)."""
    best = decode(table, w).select(*table.keys, "seg", "path")
    if table.has_long:
        joined = null_safe_join(table.df, best, [*table.keys, "seg"])
    else:
        return _predict_narrow(table, w)
    return _token_rows(table, joined)


def _token_rows(table: SequenceTable, df: DataFrame) -> DataFrame:
    own = F.slice("tags", F.col("left") + 1, F.col("n"))
    zipped = df.select(*table.keys, "seg", F.posexplode(F.arrays_zip(own.alias("tag"), F.col("path"))).alias("_i", "_t"))
    return zipped.select(
        *table.keys,
        (F.col("seg") * table.size + F.col("_i")).alias("pos"),
        F.col("_t").getField("tag").alias("tag"),
        F.col("_t").getField("path").alias("predicted"),
    )


def decode_rows(df: DataFrame, keys: Sequence[str], key_fields: str, n_tags: int, w: np.ndarray) -> DataFrame:
    """Predicted token rows straight from one-segment rows; row by row, so it also runs on a stream."""
    keys = tuple(keys)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if pc.any(pc.greater(batch.column("len"), batch.column("n"))).as_py():
            raise ValueError("a row holds part of a long sequence, which cannot be decoded alone; use predict_tags")
        tb = kernel.token_batch(batch)
        lattice = kernel.forward(tb, w, n_tags, 1, False, np.full(len(tb.size), -1))
        _, tags, ranks = kernel.best_ends(lattice, 1)
        rows = np.arange(len(tb.size))
        flat = lattice.paths(rows, tags[:, 0], ranks[:, 0])
        own, owner = tb.own, tb.owner
        return _record(batch, keys, owner, pos=own - tb.first[owner], tag=tb.tags[own], predicted=flat)

    return map_arrow(df, f"{key_fields}, pos bigint, tag bigint, predicted bigint", run, "words")


def _predict_narrow(table: SequenceTable, w: np.ndarray) -> DataFrame:
    return decode_rows(table.df, table.keys, table.key_fields(), table.n_tags, w)


def confusion(table: SequenceTable, points: Sequence[np.ndarray]) -> DataFrame:
    """Tokens per (run, tag, predicted) at several models, decoded without the loss term in one pass: (.., n)."""
    n_tags = table.n_tags

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        rows = np.arange(len(tb.size))
        counts = []
        for w in points:
            lattice = kernel.forward(tb, w, n_tags, 1, False, np.full(len(rows), -1))
            _, tags, ranks = kernel.best_ends(lattice, 1)
            cell = tb.tags[tb.own] * n_tags + lattice.paths(rows, tags[:, 0], ranks[:, 0])
            counts.append(np.bincount(cell, minlength=n_tags**2))
        found = np.array(counts).reshape(len(points), n_tags, n_tags)
        at = np.nonzero(found)
        return pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(found[at])], ["run", "tag", "predicted", "n"])

    parts = map_arrow(table.df, "run bigint, tag bigint, predicted bigint, n bigint", run, "words")
    return parts.groupBy("run", "tag", "predicted").agg(F.sum("n").alias("n"))


def hamming(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of positions where the prediction differs: (keys, distance)."""
    return predicted.groupBy(*keys).agg(F.sum((F.col("tag") != F.col("predicted")).cast("bigint")).alias("distance"))


def sequence_values(table: SequenceTable, w: np.ndarray, mu: float | None = None, k: int = 5) -> DataFrame:
    """Structural hinge per sequence, with Hamming loss: (keys, hinge, smooth).

    ``smooth`` is the smoothed score Σ u_k s_k minus the gold score; without ``mu`` it equals ``hinge``.
    """
    keys, n_tags = table.keys, table.n_tags
    best = k if mu is not None else 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        hinge, smooth = _values(tb, w, n_tags, mu, best)
        return _record(batch, keys, None, hinge=hinge, smooth=smooth)

    whole = map_arrow(table.whole, f"{table.key_fields()}, hinge double, smooth double", run, "words")
    if not table.has_long:
        return whole
    from .long_sequences import long_values

    return whole.unionByName(long_values(table, w, mu, best))


def _values(tb, w, n_tags, mu, k):
    gold = kernel.path_scores(tb, kernel.gold_indices(tb, len(w)), w)
    lattice = kernel.forward(tb, w, n_tags, k, True, np.full(len(tb.size), -1))
    scores, _, _ = kernel.best_ends(lattice, k)
    hinge = scores[:, 0] - gold
    if mu is None:
        return hinge, hinge
    weights = kernel.simplex_weights(scores, mu)
    return hinge, (weights * np.where(np.isfinite(scores), scores, 0.0)).sum(axis=1) - gold


def batch_gradient(
    tb: kernel.TokenBatch, w: np.ndarray, n_tags: int, mu: float | None, k: int, exact: bool = False
) -> np.ndarray:
    """Sum over the batch of Σ u_k Φ(x, y_k) - Φ(x, y); with no ``mu`` the best path alone counts.

    With ``exact`` the coarse and the fine part of the sum, one after the other (``exact_parts``).
    """
    dim = len(w)
    _, indices, weights = _weighted_paths(tb, w, n_tags, mu, k)
    total = weighted_counts(indices, weights, dim, exact)
    total[:dim] -= np.bincount(kernel.gold_indices(tb, dim).ravel(), minlength=dim)
    return total


def _weighted_paths(tb, w, n_tags, mu, k):
    """Tokens of all paths with a weight above zero: (segment, indices, weight) per token."""
    lattice = kernel.forward(tb, w, n_tags, k, True, np.full(len(tb.size), -1))
    scores, tags, ranks = kernel.best_ends(lattice, k)
    weights = np.ones((len(scores), 1)) if mu is None else kernel.simplex_weights(scores, mu)
    rows, rank = np.nonzero(weights > 0)
    flat = lattice.paths(rows, tags[rows, rank], ranks[rows, rank])
    part = tb.pick(rows)
    indices = kernel.path_indices(part, flat, np.full(len(rows), -1), len(w))
    owner = part.owner
    return rows[owner], indices, weights[rows, rank][owner]


def gradient_sum(
    table: SequenceTable, w: np.ndarray, mu: float | None = None, k: int = 5, exact: bool = False
) -> DataFrame:
    """Sum over all sequences of the (smoothed) hinge gradient: (idx, value); ``exact`` as in ``batch_gradient``."""
    n_tags, dim = table.n_tags, len(w) * (1 + exact)
    best = k if mu is not None else 1
    whole = sum_vectors(
        table.whole, dim, lambda batch: batch_gradient(kernel.token_batch(batch), w, n_tags, mu, best, exact), "words"
    )
    if not table.has_long:
        return whole
    from .long_sequences import long_gradient

    both = whole.unionByName(long_gradient(table, w, mu, best, exact))
    return both.groupBy("idx").agg(F.sum("value").alias("value"))


def gradient_rows(
    tb: kernel.TokenBatch, w: np.ndarray, n_tags: int, mu: float | None, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradients of ``batch_gradient`` kept apart, as (row, idx, value) triples sorted by row."""
    dim = len(w)
    gold = kernel.gold_indices(tb, dim)
    owner, indices, weights = _weighted_paths(tb, w, n_tags, mu, k)
    cells = np.concatenate([(tb.owner[:, None] * dim + gold).ravel(), (owner[:, None] * dim + indices).ravel()])
    values = np.concatenate([np.full(gold.size, -1.0), np.repeat(weights, indices.shape[1])])
    found, where = np.unique(cells, return_inverse=True)
    return found // dim, found % dim, np.bincount(where, weights=values, minlength=len(found))


def batch_minimizers(tb: kernel.TokenBatch, w: np.ndarray, n_tags: int):
    """Φ(x, y) - Φ(x, ŷ) of each sequence as (row, idx, value) triples, and the Hamming losses."""
    dim = len(w)
    lattice = kernel.forward(tb, w, n_tags, 1, True, np.full(len(tb.size), -1))
    _, tags, ranks = kernel.best_ends(lattice, 1)
    flat = lattice.paths(np.arange(len(tb.size)), tags[:, 0], ranks[:, 0])
    gold = kernel.gold_indices(tb, dim)
    other = kernel.path_indices(tb, flat, np.full(len(tb.size), -1), dim)
    row, idx, value = kernel.sparse_difference(tb, gold, other, dim)
    loss = np.bincount(tb.owner, weights=tb.tags[tb.own] != flat, minlength=len(tb.size))
    return row, idx, value, loss


def linear_minimizers(table: SequenceTable, w: np.ndarray) -> DataFrame:
    """Linear minimisation per sequence: (keys, seg, idx array, val array, loss), one row per segment.

    The parts of a long sequence add up over its segments.
    """
    keys, n_tags = table.keys, table.n_tags

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        row, idx, value, loss = batch_minimizers(tb, w, n_tags)
        per_row = np.bincount(row, minlength=len(tb.size))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
        return _record(
            batch, (*keys, "seg"), None,
            idx=pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int64())),
            val=pa.ListArray.from_arrays(offsets, pa.array(value)), loss=loss,
        )

    schema = f"{table.key_fields()}, seg bigint, idx array<bigint>, val array<double>, loss double"
    whole = map_arrow(table.whole, schema, run, "words")
    if not table.has_long:
        return whole
    from .long_sequences import long_minimizers

    return whole.unionByName(long_minimizers(table, w))
