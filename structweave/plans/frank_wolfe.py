"""Block-coordinate Frank-Wolfe with many blocks per round.

Every example (or segment of one) owns a point and a loss; the model is the sum of the points. A round takes one bucket of
the table: linear minimisation on its rows, then one line search for their joint direction. All points of a bucket move
towards their corners by the same step, so their sum moves by that step towards the sum of the corners: the state of a
bucket is one vector and one loss, and nothing is stored per example. A pass visits every bucket once. With one example per
bucket this is the sequential algorithm.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..operators.sequences import sum_vectors
from .losses import TableLoss
from .schedules import total_strong_convexity
from .solvers import Run
from .train import Fit, _log

TINY = 1e-20  # fixed value: squared length below which a direction counts as zero


def fit_frank_wolfe(
    loss: TableLoss, run: Run, *, num_passes: int = 100, n_buckets: int = 10, partitions: int | None = None,
    dev: TableLoss | None = None, test: TableLoss | None = None, stop: Callable | None = None, logging: bool = True,
) -> Fit:
    """Train by block-coordinate Frank-Wolfe. Starts at zero whatever the run's start is, returns the
    weighted average, and gives the un-averaged iterate to the stop rule."""
    if not loss.supports_lmo:
        raise TypeError(f"{type(loss).__name__} has no linear minimisation")
    strength = total_strong_convexity(run.penalties)
    if strength <= 0:
        raise ValueError("block-coordinate Frank-Wolfe needs a strongly convex penalty")
    loss.prepare(partitions, n_buckets, False)
    dim = loss.kernel.dim
    w = np.zeros(dim)
    average = np.zeros(dim)
    # A bucket's blocks take the same steps, so what a round needs of them is their sum: a vector and a loss per bucket.
    blocks = defaultdict(lambda: np.zeros(dim + 1))
    count = 0.0
    result = Fit(run.run_id, average, "frank_wolfe", loss.partitions)
    if logging:
        _log([result], [run], [0], 0, loss, dev, test, time.time())
    for epoch in range(num_passes):
        began = time.time()
        if stop is not None and stop(w, loss):
            break
        for b in range(n_buckets):
            bucket = (b + epoch) % n_buckets
            corner = _corner_sums(loss, w, bucket) / loss.n
            corner[:-1] /= strength
            gamma = _step(blocks[bucket], corner, w, strength)
            w = w - gamma * (blocks[bucket] - corner)[:-1]
            blocks[bucket] = (1 - gamma) * blocks[bucket] + gamma * corner
            average = (count * average + 2 * w) / (count + 2)
            count += 1
        result.w, result.epochs = average, epoch + 1
        if logging:
            _log([result], [run], [0], epoch + 1, loss, dev, test, began)
    return result


def _corner_sums(loss: TableLoss, w: np.ndarray, bucket: int) -> np.ndarray:
    """Sum over a bucket of the corners' vectors, and of their losses, in one narrow pass."""
    dim = loss.kernel.dim

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        values = np.asarray(batch.column("val").flatten(), dtype=np.float64)
        index = np.asarray(batch.column("idx").flatten(), dtype=np.int64)
        return np.append(np.bincount(index, weights=values, minlength=dim), np.asarray(batch.column("loss")).sum())

    table = sum_vectors(loss.linear_minimizers(w, bucket).select("idx", "val", "loss"), dim + 1, sums).toArrow()
    flat = np.zeros(dim + 1)
    flat[np.asarray(table["idx"])] = np.asarray(table["value"])
    return flat


def _step(block: np.ndarray, corner: np.ndarray, w: np.ndarray, strength: float) -> float:
    """The best step of a bucket's blocks towards their corners, between 0 and 1."""
    direction, loss_gap = block[:-1] - corner[:-1], block[-1] - corner[-1]
    length = float(direction @ direction)
    if length <= TINY:
        return 0.0
    return min(1.0, max(0.0, (strength * float(w @ direction) - loss_gap) / (strength * length)))
