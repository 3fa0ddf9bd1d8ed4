"""Candidate groups cut into rows: every pass and every solver as with whole groups."""

import numpy as np
import pytest

from structweave.operators import candidates
from structweave.plans.frank_wolfe import fit_frank_wolfe
from structweave.plans.losses import CandidateLoss
from structweave.plans.schedules import L2Penalty
from structweave.plans.solvers import Run
from structweave.plans.train import fit


@pytest.fixture(scope="module")
def df(spark):
    """A group with a third of all rows, small ones, one without an id; scores and ious tie."""
    rng = np.random.default_rng(8)
    sizes = {0: 130, None: 23, **{g: int(rng.integers(1, 15)) for g in range(1, 30)}}
    rows = [
        (g, (c * 7) % 131, float(rng.integers(0, 5)) / 4, [float(rng.integers(-2, 3)) for _ in range(3)]) for g, n in sizes.items() for c in range(n)
    ]
    return spark.createDataFrame(rows, "group_id long, cand int, iou double, feats array<float>").repartition(7)


@pytest.fixture(scope="module")
def both(df):
    return CandidateLoss(df, 3, k=4), CandidateLoss(df, 3, k=4, chunk=5)


def test_packed_rows(both):
    whole, cut = both
    assert not whole.has_long and cut.has_long and cut.prepare().n == whole.prepare().n == 31
    rows = cut.source.collect()
    assert max(len(r.ious) for r in rows) == 5 and sum(r.chunks > 1 for r in rows) > 30
    by = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        by.setdefault(r.group_id, []).append(r)
    for r in whole.source.collect():
        mine = by[r.group_id]
        assert len(mine) == mine[0].chunks and [x for m in mine for x in m.ious] == r.ious and [x for m in mine for x in m.feats] == r.feats


def test_passes(both):
    w = [np.array([0.5, -0.25, 0.125]), np.zeros(3)]
    points = [(w[0], None), (w[0], 0.7), (w[1], None)]
    whole, cut = both
    np.testing.assert_allclose(cut.gradient_means(points), whole.gradient_means(points), atol=1e-12)
    np.testing.assert_allclose(cut.value_means(w), whole.value_means(w), atol=1e-12)
    for point in w:
        a, b = whole.metrics(point), cut.metrics(point)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    found = [{r.group_id: (list(r.val), r.loss) for r in loss.linear_minimizers(w[0], 0).collect()} for loss in both]
    assert found[0].keys() == found[1].keys()
    for g in found[0]:
        np.testing.assert_allclose(np.append(*found[0][g]), np.append(*found[1][g]), atol=1e-12)


@pytest.mark.parametrize("options", [{"smoothing_coefficient": 0.5}, {}])
@pytest.mark.parametrize("mode", ["local", "minibatch"])
def test_training(both, mode, options):
    run = Run("svrg", [L2Penalty(0.1)], {"learning_rate": 0.1} | options)
    models = [fit(loss, run, num_passes=2, mode=mode, partitions=2, n_buckets=3, logging=False).w for loss in both]
    np.testing.assert_allclose(*models, atol=1e-9)
    assert np.abs(models[0]).max() > 1e-3


def test_blocks(both):
    models = [fit_frank_wolfe(loss, Run("bcfw", [L2Penalty(0.1)]), num_passes=2, n_buckets=2, logging=False).w for loss in both]
    np.testing.assert_allclose(*models, atol=1e-9)


def test_merging_is_in_parts(both, monkeypatch):
    """However the rows of a group are dealt over tasks, its best meet."""
    monkeypatch.setattr(candidates, "LANES", 3)
    whole, cut = both
    w = np.array([0.5, -0.25, 0.125])
    np.testing.assert_allclose(cut.gradient_means([(w, 0.7)]), whole.gradient_means([(w, 0.7)]), atol=1e-12)
