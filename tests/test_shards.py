"""Shards spread over partitions, draws in place, lazy steps, and examples that are spread over rows."""

import math
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from structweave.functions import decoding
from structweave.functions.columns import drawn_rows
from structweave.functions.spans import SpannedGradient
from structweave.operators import ranking, sequences
from structweave.operators.segments import segments
from structweave.operators.sequences import SequenceTable
from structweave.plans import losses, queries
from structweave.plans.chains import DenseChain, LazyChain
from structweave.plans.losses import LogisticLoss, SequenceLoss
from structweave.plans.schedules import L2Penalty, LearningRate
from structweave.plans.solvers import AcceleratedSVRG, Run, Steps
from structweave.plans.train import fit

KEYS = ("user", "day")


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)], float(rng.integers(2))) for i in range(700)]
    rows.append((None, [0.5, 0.5, 0.5], 1.0))
    return spark.createDataFrame(rows, "id long, feats array<double>, y double").repartition(4, "id")


def test_same_model_from_64_partitions(spark, examples):
    run = Run("csvrg", [L2Penalty(0.05)], {"lipschitz": 1.0, "warm_start": "extrapolation"}, seed=2)
    found = []
    for n in (1, 64):
        loss = LogisticLoss(examples.repartition(n), 3)
        found.append(fit(loss, run, num_passes=2, partitions=3, logging=False).w)
        assert loss.df.rdd.getNumPartitions() >= n
        placed = loss.df.withColumn("_p", F.spark_partition_id())
        filled = placed.groupBy("_shard").agg(F.countDistinct("_p").alias("n"), F.count("*").alias("rows")).collect()
        assert len(filled) == 3 and (n == 1 or all(r.n > 10 for r in filled)) and sum(r.rows for r in filled) == 701
        loss.release()
    np.testing.assert_allclose(found[0], found[1], atol=1e-12)


def test_number_of_shards_follows_the_table(examples, monkeypatch):
    loss = LogisticLoss(examples, 3)
    assert loss.prepare().partitions == losses.SHARDS
    loss.release()
    monkeypatch.setattr(losses, "SHARD_ROWS", 50)
    loss = LogisticLoss(examples, 3)
    assert loss.prepare().partitions == 15  # 701 rows
    loss.release()


def test_draws_in_place(spark, examples):
    """Every step of every shard draws its row once, wherever the row is."""
    loss = LogisticLoss(examples, 3).prepare(5)
    number = {(r._shard, r._row): r.id for r in loss.df.collect()}
    sizes = Counter(shard for shard, _ in number)
    assert {(s, k) for s, n in sizes.items() for k in range(n)} == set(number)
    drawn = loss.drawn(4, 1)
    found = sorted((r._shard, r._step, r.id is None, r.id) for r in drawn.select("_shard", "_step", "id").collect())
    wanted = sorted(
        (s, t, number[s, row] is None, number[s, row]) for s, n in sizes.items() for t, row in enumerate(drawn_rows(n, 4 * 1_000_003 + 1_009 + s).tolist())
    )
    assert found == wanted
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("InMemoryTableScan")[0]
    placed = drawn.withColumn("_p", F.spark_partition_id()).groupBy("_shard").agg(F.countDistinct("_p").alias("n")).collect()
    assert all(r.n == 1 for r in placed)
    loss.release()


def test_draw_counts(spark):
    rows = ranking.hash_rank(spark.range(500), "id", 3, "row", "size").repartition(9)
    counts = {r.row: r.n_draws for r in ranking.draw_counts(rows, "row", "size", 11).collect()}
    assert counts == {k: Counter(drawn_rows(500, 11).tolist())[k] for k in range(500)}


def test_shards_of_rows_that_continue_an_example(spark):
    rows = [(shard, key, seg) for shard in range(3) for key in range(40) for seg in range(1 + (key * 7 + shard) % 5)]
    df = spark.createDataFrame(rows, "s int, k int, seg int").repartition(6)
    numbered = ranking.number_in_shards(df, "s", [F.col("k"), F.col("seg")], F.col("seg") == 0, 11)
    assert numbered.rdd.getNumPartitions() > 1
    assert sorted((r.s, r.k, r.seg, r._row, r._size) for r in numbered.collect()) == [(s, k, seg, k, 40) for s, k, seg in rows]


def sparse(rng, dim):
    index = rng.choice(dim, size=rng.integers(1, 6), replace=False)
    return index, rng.normal(size=len(index))


def whole(pair, dim):
    out = np.zeros(dim)
    out[pair[0]] = pair[1]
    return out


@pytest.mark.parametrize("averaging", ["none", "uniform", "weighted"])
@pytest.mark.parametrize("anchored", [False, True])
@pytest.mark.parametrize("strength", [0.0, 0.3, 0.9999999, 10.0])
def test_lazy_steps_equal_dense_ones(averaging, anchored, strength):
    """Rate 1 at first: a strength of nearly 1 scales by 1e-7 a step, 10 / 10 in the last case by zero."""
    rng, dim = np.random.default_rng(1), 40
    rate = LearningRate("const", 0.1 if strength == 10.0 else 1.0) if strength != 0.3 else LearningRate("linear", 0.5, 7.0)
    steps = Steps(
        rng.normal(size=dim), rng.normal(size=dim), 5.0, 5.0, rate, [L2Penalty(strength / 2), L2Penalty(strength / 2, rng.normal(size=dim))], None,
        averaging, rng.normal(size=dim) if anchored else None, rng.normal(size=dim) if anchored else None,
    )
    assert LazyChain.fits(steps)
    lazy, dense = LazyChain(replace(steps)), DenseChain(replace(steps))
    for _ in range(60):
        gradient, fixed = sparse(rng, dim), sparse(rng, dim) if anchored else None
        lazy.step(gradient, fixed)
        dense.step(whole(gradient, dim), None if fixed is None else whole(fixed, dim))
        np.testing.assert_allclose(lazy.w[np.arange(dim)], dense.w, rtol=1e-9, atol=1e-12)
    for a, b in zip(lazy.result(), dense.result()):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


def tokens(spark, seed=0, users=9, longest=60):
    """Few words, chunks and tags, so scores tie."""
    rng = np.random.default_rng(seed)
    rows = []
    for user in range(users):
        for day in range(3):
            n = int(rng.integers(1, longest))
            rows += [(user if user else None, day, p, n, int(rng.integers(3)), int(rng.integers(2)), int(rng.integers(2)), int(rng.integers(3))) for p in range(n)]
    fields = "user int, day int, pos bigint, len bigint, word bigint, pos_tag bigint, chunk bigint, tag bigint"
    return spark.createDataFrame(rows, fields)


@pytest.mark.parametrize("mu", [None, 0.7])
def test_spanned_gradient_equals_that_of_the_whole_sequence(spark, mu):
    """Bit for bit, ties included."""
    dim, n_tags, k = 31, 3, 4
    w = np.round(np.random.default_rng(5).normal(size=dim) * 2) / 4
    rows = tokens(spark)
    uncut = {(r.user, r.day): r for r in segments(rows, KEYS).collect()}
    cut = segments(rows, KEYS, 8).orderBy(*KEYS, "seg").toArrow().combine_chunks()
    at = Counter()
    batches = cut.to_batches()
    parts = [b.slice(i, 1) for b in batches for i in range(b.num_rows)]
    by = {}
    for part in parts:
        by.setdefault((part.column("user")[0].as_py(), part.column("day")[0].as_py()), []).append(part)
    names = ["len", "left", "n", "words", "pos_tags", "chunks", "tags"]
    for key, mine in by.items():
        got = SpannedGradient(w, n_tags, mu, k)
        for part in mine:
            got.there(decoding.token_batch(part))
        for part in reversed(mine):
            got.back(decoding.token_batch(part))
        row = uncut[key]
        batch = pa.RecordBatch.from_pylist([{c: row[c] for c in names}])
        wanted = sequences.batch_gradient(decoding.token_batch(batch), w, n_tags, mu, 1 if mu is None else k)
        np.testing.assert_allclose(whole(got.gradient(mu), dim), wanted, atol=1e-12)
        at[len(mine)] += 1
    assert len(at) > 4


@pytest.mark.parametrize("algorithm,options", [("svrg", {"learning_rate": 0.05, "smoothing_coefficient": 1.0}), ("sgd", {"initial_learning_rate": 0.05})])
def test_long_sequences_in_inner_epochs(spark, algorithm, options):
    """Sequences cut into segments of 8 train the model that uncut ones train."""
    rows, found = tokens(spark, 4), []
    for size in (4096, 8):
        table = SequenceTable.from_tokens(rows, KEYS, 3, size)
        assert table.has_long == (size == 8)
        loss = SequenceLoss(table, 31, k=3)
        found.append(fit(loss, Run(algorithm, [L2Penalty(0.01)], options), num_passes=2, partitions=2, logging=False).w)
        assert loss.n == 27
        loss.release()
    np.testing.assert_allclose(found[0], found[1], atol=1e-9)
    assert np.abs(found[0]).max() > 1e-3


@pytest.mark.parametrize("size", [4096, 8])
def test_bits_of_a_sequence_model_do_not_depend_on_partitions_or_batches(spark, size):
    """With little smoothing, what one sum rounds otherwise is another model some passes later."""
    rows, found = tokens(spark, 4).persist(), []
    options = {"learning_rate": 0.05, "initial_moreau": 0.01, "initial_smoothing": 0.5, "smoothing_rule": "expo"}
    for n, batch in ((1, 10_000), (5, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        table = SequenceTable.from_tokens(rows, KEYS, 3, size)
        spread = SequenceTable(table.df.repartition(n), table.keys, table.n_tags, table.size, table.has_long)
        loss = SequenceLoss(spread, 31, k=3)
        found.append(fit(loss, Run("csvrg_lr", [L2Penalty(0.01)], options), num_passes=4, partitions=3, logging=False).w)
        loss.release()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows.unpersist()
    assert np.array_equal(*found) and np.abs(found[0]).max() > 1e-3


def test_fit_sequences_runs_its_smoothing_schedule(spark, tmp_path, monkeypatch):
    """The coefficient falls from pass to pass through the whole budget, in the steps that train the model."""
    at, kinds = datetime(2024, 1, 1), ["click", "error", "purchase", "signup", "view"]
    rows = [(i, i % 4, at + timedelta(hours=7 * i), kinds[i * i % 5], float(i * 37 % 200)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    begun, begin = [], AcceleratedSVRG.begin

    def recorded(self, *args):
        begun.append(begin(self, *args))
        return begun[-1]

    monkeypatch.setattr(AcceleratedSVRG, "begin", recorded)
    found = queries.fit_sequences(spark, str(tmp_path)).toPandas().set_index("idx")["w"]
    factor = math.sqrt(1 - math.sqrt(0.5) / 2)
    assert [steps.mu for steps in begun] == pytest.approx([2 * factor**t for t in range(50)])
    assert not begun[0].w.any() and all((a.w != b.w).any() for a, b in zip(begun, begun[1:]))
    assert len(found) == 997 and np.isfinite(found).all() and (found != 0).any()
