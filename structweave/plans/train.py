"""Training: epochs of Spark jobs around small driver vectors, for one run or many runs that share every pass.

``mode`` says how the n dependent steps of a pass become jobs:

* ``local`` (default): each shard of the table runs a sequential inner epoch over its own rows, and the results are
  averaged by row count. One shard is the sequential algorithm itself.
* ``minibatch``: one job and one step per bucket of the table.
* ``batch``: one job and one step per pass.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import stretches
from ..operators.sequences import slices
from .chains import DenseChain, LazyChain
from .losses import TableLoss
from .schedules import penalty_value
from .solvers import Run, Solver, make_solver

LOCAL, MINIBATCH, BATCH = "local", "minibatch", "batch"
FEW_ROWS = 200
LOG_SCHEMA = "run_id string, epoch int, split string, metric string, value double, seconds double"


@dataclass
class Fit:
    """A trained model with its log and how it was run."""

    run_id: str
    w: np.ndarray
    mode: str
    partitions: int
    log: list = field(default_factory=list)
    epochs: int = 0

    def weights(self, spark: SparkSession) -> DataFrame:
        """(run_id, idx, w)."""
        table = pa.table({"run_id": [self.run_id] * len(self.w), "idx": np.arange(len(self.w)), "w": self.w})
        return spark.createDataFrame(table)


def train_log(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """Long log of all runs: (run_id, epoch, split, metric, value, seconds)."""
    return spark.createDataFrame([row for fit in fits for row in fit.log], LOG_SCHEMA)


def gradient_norm_below(tolerance: float = 1e-5, penalties=()) -> Callable:
    """Stop rule: norm of the mean loss gradient below ``tolerance``; penalties count only when given."""

    def reached(w: np.ndarray, loss: TableLoss) -> bool:
        gradient = loss.gradient_means([(w, None)])[0]
        for penalty in penalties:
            gradient = gradient + penalty.gradient(w)
        return float(np.linalg.norm(gradient)) < tolerance

    return reached


def fit(
    loss: TableLoss, run: Run | None = None, *, num_passes: int = 100, mode: str = LOCAL,
    partitions: int | None = None, n_buckets: int = 1, dev: TableLoss | None = None, test: TableLoss | None = None,
    stop: Callable | None = None, logging: bool = True,
) -> Fit:
    """Train one model."""
    return fit_many(
        loss, [run or Run()], num_passes=num_passes, mode=mode, partitions=partitions, n_buckets=n_buckets,
        dev=dev, test=test, stop=stop, logging=logging,
    )[0]


def fit_many(
    loss: TableLoss, runs: Sequence[Run], *, num_passes: int = 100, mode: str = LOCAL, partitions: int | None = None,
    n_buckets: int = 1, dev: TableLoss | None = None, test: TableLoss | None = None, stop: Callable | None = None,
    logging: bool = True,
) -> list[Fit]:
    """Train many models over one persisted table; each pass serves all of them in the same jobs."""
    if mode not in (LOCAL, MINIBATCH, BATCH):
        raise ValueError(f"unknown mode: {mode}")
    loss.prepare(partitions, n_buckets if mode == MINIBATCH else 1, mode == LOCAL)
    if mode == LOCAL and loss.partitions > 1 and loss.n / loss.partitions < FEW_ROWS:
        warnings.warn(f"only {loss.n / loss.partitions:.0f} rows per partition; averaging will be crude", stacklevel=2)
    solvers = [make_solver(run, loss.kernel.dim) for run in runs]
    fits = [Fit(run.run_id, solver.w.copy(), mode, loss.partitions) for run, solver in zip(runs, solvers)]
    active = list(range(len(runs)))
    if logging:
        _log(fits, runs, active, 0, loss, dev, test, time.time())
    for epoch in range(num_passes):
        began = time.time()
        if stop is not None:
            active = [r for r in active if not stop(fits[r].w, loss)]
        if not active:
            break
        live = [solvers[r] for r in active]
        steps = _begin(loss, live, epoch)
        if mode == LOCAL:
            results = _inner_epochs(loss, steps, [runs[r].seed for r in active], epoch)
        else:
            buckets = [None] if mode == BATCH else [(b + epoch) % n_buckets for b in range(n_buckets)]
            results = _shared_steps(loss, steps, buckets)
        for r, solver, result in zip(active, live, results):
            fits[r].w = solver.end(*result).copy()
            fits[r].epochs = epoch + 1
        if logging:
            _log(fits, runs, active, epoch + 1, loss, dev, test, began)
    return fits


def _begin(loss: TableLoss, solvers: Sequence[Solver], epoch: int):
    """Batch gradients of all runs that need one, in a single job, then the steps of the epoch."""
    anchors = [solver.anchor(epoch, loss.n) for solver in solvers]
    wanted = [(w, solver.smoothing(epoch)) for w, solver in zip(anchors, solvers) if w is not None]
    gradients = iter(loss.gradient_means(wanted)) if wanted else iter(())
    return [solver.begin(epoch, None if w is None else next(gradients)) for w, solver in zip(anchors, solvers)]


def _shared_steps(loss: TableLoss, steps, buckets):
    """One step per bucket: mean gradients at the iterates, and at the anchors, of all runs in one job."""
    for bucket in buckets:
        points = [(s.w, s.mu) for s in steps] + [(s.anchor, s.mu) for s in steps if s.anchor is not None]
        means = loss.gradient_means(points, bucket)
        anchored = iter(means[len(steps) :])
        for gradient, s in zip(means, steps):
            s.apply(gradient if s.anchor is None else gradient - next(anchored) + s.anchor_gradient)
    return [(s.w, s.average, len(buckets)) for s in steps]


def _inner_epochs(loss: TableLoss, steps, seeds, epoch: int):
    """Sequential inner epochs next to the rows, averaged by row count; runs of one seed share the draws and a job.

    Which row a step draws follows from (seed, epoch, shard, step) alone (``TableLoss.drawn``), so neither the cluster
    nor the size of Arrow batches changes a model, and a task that runs again repeats itself.
    """
    out: list = [None] * len(steps)
    for seed in dict.fromkeys(seeds):
        mine = [k for k, s in enumerate(seeds) if s == seed]
        for k, result in zip(mine, _inner_epoch(loss, [steps[k] for k in mine], loss.drawn(seed, epoch))):
            out[k] = result
    return out


def _inner_epoch(loss: TableLoss, steps, drawn: DataFrame):
    kernel, dim, m = loss.kernel, loss.kernel.dim, len(steps)

    def sums(chains, rows: int) -> pa.RecordBatch:
        vectors = [v for chain in chains for v in chain.result()]
        flat = np.concatenate([*vectors, np.ones(2)]) * rows
        flat[-1] = 1
        index = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(index), pa.array(flat[index])], ["idx", "value"])

    def run(batches):
        shard, rows, chains, spanned = None, 0, [], []
        for batch in slices(batches, kernel.weigh):
            for start, end in stretches(batch.column("_shard")):
                if (found := batch.column("_shard")[start].as_py()) != shard:
                    if rows:
                        yield sums(chains, rows)
                    shard, rows = found, 0
                    chains = [LazyChain(s) if kernel.sparse and LazyChain.fits(s) else DenseChain(s) for s in steps]
                part = batch.slice(start, end - start)
                for whole, piece in _examples(kernel, part):
                    if whole:
                        rows += piece.num_rows
                        _advance(kernel, chains, kernel.load(piece))
                    else:
                        rows += _advance_spanned(kernel, chains, spanned, piece)
        if rows:
            yield sums(chains, rows)

    partial = drawn.mapInArrow(run, "idx bigint, value double")
    # One value per shard, added up in order of size: the sum is the same whichever task ends first.
    total = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda total, value: total + value)
    table = partial.groupBy("idx").agg(total.alias("value")).toArrow()
    flat = np.zeros(2 * m * dim + 2)
    flat[np.asarray(table["idx"])] = np.asarray(table["value"])
    rows, chains = max(flat[-2], 1.0), max(flat[-1], 1.0)
    vectors = flat[:-2].reshape(m, 2, dim) / rows
    return [(w, average, rows / chains) for w, average in vectors]


def _examples(kernel, batch: pa.RecordBatch):
    """(whole, rows): rows that are examples of their own together, rows of a spread example one by one."""
    spans = kernel.spans(batch)
    spread = np.zeros(batch.num_rows, dtype=bool) if spans is None else spans > 1
    for a, b in stretches(spread):
        if not spread[a]:
            yield True, batch.slice(a, b - a)
        else:
            yield from ((False, batch.slice(i, 1)) for i in range(a, b))


def _advance(kernel, chains, examples) -> None:
    """One step of every chain per example."""
    for chain in chains:
        s = chain.steps
        lazy = isinstance(chain, LazyChain)
        support, one = (kernel.support_rows, kernel.example_rows) if lazy else (kernel.support, kernel.example_gradient)
        fixed = None if s.anchor is None else support(examples, s.anchor, s.mu)
        for i in range(kernel.size(examples)):
            chain.step(one(examples, i, chain.w, s.mu), None if fixed is None else fixed(i))


def _advance_spanned(kernel, chains, spanned: list, row: pa.RecordBatch) -> int:
    """Take a row of an example that is spread over rows; the last one makes the step and counts as an example."""
    order, n = row.column("_order")[0].as_py(), int(kernel.spans(row)[0])
    last = 2 * n - 1 if kernel.returns else n - 1
    if not order:
        points = [[c.w] if c.steps.anchor is None else [c.w, c.steps.anchor] for c in chains]
        spanned[:] = [[kernel.spanned(w, c.steps.mu) for w in ws] for ws, c in zip(points, chains)]
    segment = kernel.load(row)
    for gradient in (g for each in spanned for g in each):
        (gradient.there if order < n else gradient.back)(segment)
    if order < last:
        return 0
    for chain, each in zip(chains, spanned):
        parts = [g.gradient(chain.steps.mu) for g in each]
        if isinstance(chain, DenseChain) and kernel.sparse:
            parts = [np.bincount(idx, weights=value, minlength=kernel.dim) for idx, value in parts]
        chain.step(*parts)
    return 1


def _log(fits, runs, active, epoch, loss, dev, test, began):
    """Objective on train (plain loss plus penalties) and, where given, objective and metrics elsewhere."""
    points = [fits[r].w for r in active]
    penalties = [penalty_value(runs[r].penalties, fits[r].w) for r in active]
    rows = []
    for split, part in (("train", loss), ("dev", dev), ("test", test)):
        if part is None:
            continue
        values = part.value_means(points)
        told = [{}] * len(points) if split == "train" else part.metrics_many(points)
        for r, value, penalty, found in zip(active, values, penalties, told):
            rows.append((r, split, "objective", float(value + penalty)))
            rows.extend((r, split, name, float(x)) for name, x in found.items())
    seconds = time.time() - began
    for r, split, metric, value in rows:
        fits[r].log.append((runs[r].run_id, epoch, split, metric, value, seconds))
