"""Gradients one after the other, at a model that changes in between."""

import numpy as np
import pyarrow as pa
import pytest

from structweave.functions import decoding
from structweave.operators import sequences
from structweave.plans.chains import ScaledVector
from structweave.plans.losses import CandidateKernel, SequenceKernel

DIM, TAGS = 101, 4


@pytest.fixture
def examples():
    rng = np.random.default_rng(8)
    sizes = [1, 2, 3, 7, 1, 30, 4] * 20
    columns = {c: [rng.integers(0, 4, n).tolist() for n in sizes] for c in ("words", "pos_tags", "chunks", "tags")}
    columns |= {"left": [0] * len(sizes), "n": sizes, "len": sizes}
    return decoding.token_batch(pa.RecordBatch.from_pydict(columns))


@pytest.mark.parametrize("mu, k", [(None, 1), (2.0, 3), (0.1, 5), (50.0, 7)])
@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_the_same_as_by_the_batch(examples, monkeypatch, mu, k, scale):
    monkeypatch.setattr(decoding, "AHEAD", 100)
    rng = np.random.default_rng(9)
    w = ScaledVector(rng.integers(-3, 4, DIM) / 4 * scale, rng.normal(size=DIM) * scale)
    kernel = SequenceKernel(DIM, TAGS, k)
    for i in [*range(len(examples.size)), 3, 139, 0]:
        w.a, w.b = rng.normal(), rng.normal()
        idx, value = kernel.example_rows(examples, i, w, mu)
        _, expected, at = sequences.gradient_rows(examples.one(i), w, TAGS, mu, 1 if mu is None else k)
        assert idx.tolist() == expected.tolist() and value.tolist() == at.tolist()


def test_features_are_hashed_by_the_batch(examples, monkeypatch):
    calls = []
    real = decoding.template_indices
    monkeypatch.setattr(decoding, "template_indices", lambda *a: calls.append(1) or real(*a))
    kernel, w = SequenceKernel(DIM, TAGS, 3), np.zeros(DIM)
    for i in range(len(examples.size)):
        kernel.example_rows(examples, i, w, 2.0)
    assert len(calls) == 1


def test_candidate_steps_project_one_group_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    sizes, kernel = [1, 2, 3, 7, 6] * 10, CandidateKernel(3, 5)
    columns = {"ious": [rng.random(n).tolist() for n in sizes], "feats": [rng.normal(size=3 * n).tolist() for n in sizes]}
    examples, w = kernel.load(pa.RecordBatch.from_pydict(columns)), rng.normal(size=3)
    for mu in (0.05, 0.5, 20.0):
        expected = [kernel.gradient_sum(kernel.take(examples, i), w, mu) for i in range(len(sizes))]
        with monkeypatch.context() as only:
            only.setattr(decoding, "simplex_weights", None)  # the kernel of whole batches, slow on one row
            found = [kernel.example_gradient(examples, i, w, mu) for i in range(len(sizes))]
        np.testing.assert_allclose(found, expected, atol=1e-12)
    scores = np.array([3.0, 2.5, 2.5, -np.inf])
    for mu in (0.1, 1.0, 10.0):
        assert decoding.mixture(scores.tolist(), mu) == decoding.simplex_weights(scores[None, :], mu)[0].tolist()
