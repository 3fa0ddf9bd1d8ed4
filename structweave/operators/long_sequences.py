"""Exact decoding of sequences that span many segments.

The max-plus product is associative, so a long sequence is decoded as a tree. Each segment yields a small
node: the K best scores for every (tag before, last tag) pair. FAN consecutive nodes combine into one, level
by level, until one node per sequence is left. The K best ends found there are then traced down the tree to
an (entry, exit, rank) triple per segment, and each segment recovers its part of the path. No task ever sees
more than FAN nodes or one segment of a sequence.

Ties need the order of paths read backwards across segments. A node therefore carries, beside its scores,
the dense rank of each path among all paths of the node that end in the same tag (``place``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decoding as kernel
from ..functions.columns import null_safe_join
from ..session import materialize
from .candidates import simplex_weights
from .sequences import PIECE, SequenceTable, _ragged, _record, map_arrow, sum_vectors, weighted_counts

FAN = 64
NODE = "idx bigint, scores array<double>, place array<bigint>"
REQUEST = "idx bigint, rank int, score double, entry bigint, exit bigint, nth bigint"


@dataclass
class Node:
    """scores and place of shape (tags + 1 entries, tags, K); entry 0 is the start of the sequence."""

    scores: np.ndarray
    place: np.ndarray

    @classmethod
    def read(cls, scores, place, n_tags: int, k: int) -> Node:
        shape = (n_tags + 1, n_tags, k)
        return cls(np.asarray(scores, dtype=float).reshape(shape), np.asarray(place, dtype=np.int64).reshape(shape))


def _dense_places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Dense ranks of key tuples (entries, tags, K, parts), separately for each tag, where ``found``."""
    place = np.zeros(found.shape, dtype=np.int64)
    for tag in range(found.shape[1]):
        here = found[:, tag, :]
        if here.any():
            _, inverse = np.unique(keys[:, tag][here], axis=0, return_inverse=True)
            place[:, tag, :][here] = inverse.ravel()
    return place


def multiply(left: Node, right: Node) -> tuple[Node, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Node of the concatenation, and for each of its paths (tag between, rank in left, rank in right)."""
    entries, n_tags, k = left.scores.shape
    shape = (entries, n_tags, n_tags, k, k)  # entry, last tag, tag between, rank left, rank right
    score = left.scores[:, None, :, :, None] + right.scores[1:].transpose(1, 0, 2)[None, :, :, None, :]
    behind = np.broadcast_to(right.place[1:].transpose(1, 0, 2)[None, :, :, None, :], shape)
    before = np.broadcast_to(left.place[:, None, :, :, None], shape)
    between = np.broadcast_to(np.arange(n_tags)[None, None, :, None, None], shape)
    flat = (entries, n_tags, n_tags * k * k)
    parts = [x.reshape(flat) for x in (behind, between, before)]
    order = np.lexsort((parts[2], parts[1], parts[0], -score.reshape(flat)), axis=-1)[:, :, :k]
    scores = np.take_along_axis(score.reshape(flat), order, axis=2)
    keys = np.stack([np.take_along_axis(x, order, axis=2) for x in parts], axis=-1)
    trace = (order // (k * k), order // k % k, order % k)
    return Node(scores, _dense_places(keys, np.isfinite(scores))), trace


#: Bytes of back-pointers that a task holds at a time, when it decodes segments from every tag before them.
POINTERS = 1 << 26


def _places(lattice: kernel.Lattice, found: np.ndarray) -> np.ndarray:
    """Dense ranks of the paths (segments, entries, tags, K), read backwards, for each segment and last tag."""
    _, entries, n_tags, k = found.shape
    segment, entry, tag, rank = np.nonzero(found)
    row = segment * entries + entry
    size = lattice.size[row]
    flat = lattice.paths(row, tag, rank)
    read = np.full((len(row), 2 + int(size.max(initial=0))), -1)
    read[:, 0], read[:, 1] = segment, tag
    owner = np.repeat(np.arange(len(row)), size)
    ends = np.cumsum(size)
    read[owner, 1 + ends[owner] - np.arange(len(flat))] = flat
    ordered, inverse = np.unique(read, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    first = np.full((found.shape[0], n_tags), len(ordered))
    np.minimum.at(first, (ordered[:, 0], ordered[:, 1]), np.arange(len(ordered)))
    place = np.zeros(found.shape, dtype=np.int64)
    place[segment, entry, tag, rank] = inverse - first[segment, tag]
    return place


def _leaves(table: SequenceTable, w, k, use_loss) -> DataFrame:
    """Nodes of all segments: one pass of the kernel decodes many segments from every tag before them."""
    keys, n_tags = table.keys, table.n_tags
    at_once = max(1, POINTERS // (table.size * (n_tags + 1) * n_tags * k * 16))

    def nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        n, entries = batch.num_rows, np.arange(-1, n_tags)
        many = tb.pick(np.repeat(np.arange(n), len(entries)))
        lattice = kernel.forward(many, w, n_tags, k, use_loss, np.tile(entries, n))
        scores = lattice.table.reshape(n, len(entries), n_tags, k).copy()
        start = np.asarray(batch.column("seg")) == 0
        scores[start, 1:] = kernel.MISSING
        scores[~start, 0] = kernel.MISSING
        place = _places(lattice, np.isfinite(scores))
        offsets = pa.array(np.arange(n + 1) * scores[0].size, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (scores, place)]
        return _record(batch, keys, None, idx=batch.column("seg"), scores=lists[0], place=lists[1])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                yield nodes(batch.slice(a, at_once))

    return table.long.mapInArrow(run, f"{table.key_fields()}, {NODE}")


def _children(pdf: pd.DataFrame, n_tags: int, k: int) -> list[Node]:
    ordered = pdf.sort_values("idx")
    return [Node.read(s, p, n_tags, k) for s, p in zip(ordered["scores"], ordered["place"])]


def _parents(nodes: DataFrame, table: SequenceTable, k: int) -> DataFrame:
    keys, n_tags = list(table.keys), table.n_tags

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        total, *rest = _children(pdf, n_tags, k)
        for node in rest:
            total, _ = multiply(total, node)
        out = pdf[keys].head(1).copy()
        out["idx"] = pdf["idx"].iloc[0] // FAN
        out["scores"] = [total.scores.ravel()]
        out["place"] = [total.place.ravel()]
        return out

    parent = F.floor(F.col("idx") / F.lit(float(FAN))).alias("_parent")
    return nodes.groupBy(*keys, parent).applyInPandas(combine, f"{table.key_fields()}, {NODE}")


def _best_ends(roots: DataFrame, table: SequenceTable, k: int) -> DataFrame:
    keys, n_tags = table.keys, table.n_tags

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ranks, scores, tags, nths = [], [], [], [], []
        for i in range(batch.num_rows):
            node = Node.read(batch.column("scores")[i].values, batch.column("place")[i].values, n_tags, k)
            score, place = node.scores[0].ravel(), node.place[0].ravel()
            tag = np.repeat(np.arange(n_tags), k)
            order = np.lexsort((place, tag, -score))[:k]
            order = order[np.isfinite(score[order])]
            rows.extend([i] * len(order))
            ranks.extend(range(1, len(order) + 1))
            scores.extend(score[order])
            tags.extend(tag[order])
            nths.extend(order % k)
        rows = np.array(rows, dtype=np.int64)
        zero = np.zeros(len(rows), dtype=np.int64)
        return _record(
            batch, keys, rows, idx=zero, rank=np.array(ranks, dtype=np.int32), score=np.array(scores, dtype=float),
            entry=zero - 1, exit=np.array(tags, dtype=np.int64), nth=np.array(nths, dtype=np.int64),
        )

    return map_arrow(roots, f"{table.key_fields()}, {REQUEST}", run)


def _descend(requests: DataFrame, nodes: DataFrame, table: SequenceTable, k: int) -> DataFrame:
    """Requests on parents become requests on their children."""
    keys, n_tags = list(table.keys), table.n_tags

    def trace(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        children = _children(pdf, n_tags, k)
        first = int(pdf["idx"].min())
        total, traces = children[0], []
        for node in children[1:]:
            total, step = multiply(total, node)
            traces.append(step)
        rows = []
        for r in asked.itertuples(index=False):
            start, last, nth = r.entry + 1, r.exit, r.nth
            for child in range(len(children) - 1, 0, -1):
                between, left, right = (x[start, last, nth] for x in traces[child - 1])
                rows.append((first + child, r.rank, r.score, between, last, right))
                last, nth = between, left
            rows.append((first, r.rank, r.score, r.entry, last, nth))
        out = pd.DataFrame(rows, columns=["idx", "rank", "score", "entry", "exit", "nth"])
        for name in keys:
            out[name] = pdf[name].iloc[0]
        return out[[*keys, "idx", "rank", "score", "entry", "exit", "nth"]]

    asked = requests.withColumn("_parent", F.col("idx")).groupBy(*keys, "_parent")
    parent = F.floor(F.col("idx") / F.lit(float(FAN))).alias("_parent")
    return asked.cogroup(nodes.groupBy(*keys, parent)).applyInPandas(trace, f"{table.key_fields()}, {REQUEST}")


def decode_long(table: SequenceTable, w: np.ndarray, k: int, use_loss: bool) -> DataFrame:
    """K best taggings of the long sequences, in the rows of ``sequences.decode``."""
    keys, n_tags = table.keys, table.n_tags
    levels = [materialize(_leaves(table, w, k, use_loss))]
    last = levels[0].agg(F.max("idx")).first()[0] or 0
    while last > 0:
        levels.append(materialize(_parents(levels[-1], table, k)))
        last //= FAN
    requests = _best_ends(levels[-1], table, k)
    for nodes in reversed(levels[:-1]):
        requests = _descend(requests, nodes, table, k)
    asked = null_safe_join(table.long, requests.withColumnRenamed("idx", "seg"), [*keys, "seg"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        entry, last_tag, nth = (np.asarray(batch.column(c), dtype=np.int64) for c in ("entry", "exit", "nth"))
        lattice = kernel.forward(tb, w, n_tags, k, use_loss, entry)
        path = lattice.paths(np.arange(batch.num_rows), last_tag, nth)
        columns = {c: batch.column(c) for c in ("rank", "score", "entry")}
        return _record(batch, (*keys, "seg"), None, **columns, path=_ragged(path, tb.size))

    return map_arrow(asked, f"{table.key_fields()}, seg bigint, {PIECE}", run, "words")


def _gold_scores(table: SequenceTable, w: np.ndarray) -> DataFrame:
    keys = table.keys

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb = kernel.token_batch(batch)
        return _record(batch, keys, None, part=kernel.path_scores(tb, kernel.gold_indices(tb, len(w)), w))

    parts = map_arrow(table.long, f"{table.key_fields()}, part double", run, "words")
    return parts.groupBy(*table.keys).agg(F.sum("part").alias("gold"))


def _weighted(table: SequenceTable, best: DataFrame, mu: float | None) -> DataFrame:
    """One row per path (keys, rank, score, weight)."""
    ends = best.where(F.col("seg") == 0).select(*table.keys, "rank", "score")
    if mu is None:
        return ends.where(F.col("rank") == 1).withColumn("weight", F.lit(1.0))
    return simplex_weights(ends, mu, table.keys, "score")


def long_values(table: SequenceTable, w: np.ndarray, mu: float | None, k: int) -> DataFrame:
    """Hinge and smoothed hinge of the long sequences: (keys, hinge, smooth)."""
    weighted = _weighted(table, materialize(decode_long(table, w, k, True)), mu)
    scores = weighted.groupBy(*table.keys).agg(
        F.max("score").alias("_best"), F.sum(F.col("score") * F.col("weight")).alias("_smooth")
    )
    return null_safe_join(scores, _gold_scores(table, w), table.keys).select(
        *table.keys,
        (F.col("_best") - F.col("gold")).alias("hinge"),
        (F.col("_smooth") - F.col("gold")).alias("smooth"),
    )


def _path_indices(batch: pa.RecordBatch, dim: int) -> tuple[kernel.TokenBatch, np.ndarray, np.ndarray]:
    tb = kernel.token_batch(batch)
    path = np.asarray(batch.column("path").flatten(), dtype=np.int64)
    return tb, path, kernel.path_indices(tb, path, np.asarray(batch.column("entry"), dtype=np.int64), dim)


def long_gradient(table: SequenceTable, w: np.ndarray, mu: float | None, k: int, exact: bool = False) -> DataFrame:
    """Sum of Σ u_k Φ(x, y_k) - Φ(x, y) over the long sequences: (idx, value); ``exact`` as in ``batch_gradient``."""
    dim, keys = len(w), list(table.keys)
    best = materialize(decode_long(table, w, k, True))
    weights = _weighted(table, best, mu).where(F.col("weight") > 0).select(*keys, "rank", "weight")
    pieces = null_safe_join(table.long, null_safe_join(best, weights, [*keys, "rank"]), [*keys, "seg"])

    def paths(batch: pa.RecordBatch) -> np.ndarray:
        tb, _, indices = _path_indices(batch, dim)
        weight = np.asarray(batch.column("weight"), dtype=float)[tb.owner]
        return weighted_counts(indices, weight, dim, exact)

    def gold(batch: pa.RecordBatch) -> np.ndarray:
        return -np.bincount(kernel.gold_indices(kernel.token_batch(batch), dim).ravel(), minlength=dim).astype(float)

    ends = sum_vectors(pieces, dim * (1 + exact), paths, "words")
    both = ends.unionByName(sum_vectors(table.long, dim, gold, "words"))
    return both.groupBy("idx").agg(F.sum("value").alias("value"))


def long_minimizers(table: SequenceTable, w: np.ndarray) -> DataFrame:
    """Φ(x, y) - Φ(x, ŷ) and Hamming loss per segment of the long sequences."""
    dim, keys = len(w), table.keys
    pieces = null_safe_join(table.long, decode_long(table, w, 1, True), [*keys, "seg"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tb, path, indices = _path_indices(batch, dim)
        row, idx, value = kernel.sparse_difference(tb, kernel.gold_indices(tb, dim), indices, dim)
        loss = np.bincount(tb.owner, weights=tb.tags[tb.own] != path, minlength=len(tb.size))
        size = np.bincount(row, minlength=len(tb.size))
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        val = pa.ListArray.from_arrays(offsets, pa.array(value))
        return _record(batch, (*keys, "seg"), None, idx=_ragged(idx, size), val=val, loss=loss)

    schema = f"{table.key_fields()}, seg bigint, idx array<bigint>, val array<double>, loss double"
    return map_arrow(pieces, schema, run, "words")
