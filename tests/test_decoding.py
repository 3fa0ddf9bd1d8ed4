"""Decoding, losses and gradients of sequences against brute force written from the slot table."""

import itertools

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from structweave.operators import long_sequences
from structweave.operators import sequences as Q
from structweave.plans.frank_wolfe import fit_frank_wolfe
from structweave.plans.losses import SequenceLoss
from structweave.plans.schedules import L2Penalty
from structweave.plans.solvers import Run
from structweave.plans.train import fit
from structweave.streaming import predict_stream

N_TAGS, DIM = 3, 101
W = np.array([((i * 37) % 23 - 11) / 16 for i in range(DIM)])


def slot_indices(words, pos, chunk, i, prev, cur):
    """The 27 indices at position i, spelled out."""
    n = len(words)

    def at(values, j):
        return -1 if j < 0 else -2 if j >= n else values[j]

    w, p, c = (lambda j: at(words, j)), (lambda j: at(pos, j)), (lambda j: at(chunk, j))
    pairs = [(w(i), cur), (w(i), prev)]
    pairs += [(w(i - 2), cur), (w(i - 2), prev)] if i > 1 else [None, None]
    pairs += [(w(i + 2), cur), (w(i + 2), prev)] if i < n - 2 else [None, None]
    pairs += [(w(i - 1), cur), (w(i - 1), prev), (w(i + 1), cur), (w(i + 1), prev), (prev, cur)]
    pairs += [(p(i - 1), p(i)), (p(i), p(i + 1)), (c(i - 1), c(i)), (c(i), c(i + 1))]
    for tag in (cur, prev):
        pairs += [(tag, p(i)), (tag, p(i + 1)), (tag, p(i - 1)), (tag, c(i)), (tag, c(i + 1)), (tag, c(i - 1))]
    assert len(pairs) == 27

    def code(slot, pair):
        h = 17
        for part in (slot, *pair):
            h = 31 * h + part
        return h % DIM

    return [0 if pair is None else code(slot, pair) for slot, pair in enumerate(pairs)]


def phi(seq, tags):
    out = np.zeros(DIM)
    for i, tag in enumerate(tags):
        for j in slot_indices(*seq[:3], i, tags[i - 1] if i else -1, tag):
            out[j] += 1
    return out


def brute(seq, k, use_loss=True):
    """All taggings by (score desc, reversed path), first k."""
    gold = seq[3]
    scored = []
    for tags in itertools.product(range(N_TAGS), repeat=len(gold)):
        loss = sum(a != b for a, b in zip(tags, gold)) if use_loss else 0
        scored.append((W @ phi(seq, tags) + loss, tags))
    scored.sort(key=lambda x: (-x[0], x[1][::-1]))
    return scored[:k]


def project(scores, mu):
    """Projection onto the simplex by bisection on the shift."""
    x = np.array(scores) / mu
    low, high = x.min() - 1, x.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(x - mid, 0).sum() > 1 else (low, mid)
    return np.maximum(x - low, 0)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 4, 5, 6, 6, 2, 1, 5]
    return [[list(map(int, rng.integers(0, 4, n))) for _ in range(3)] + [list(map(int, rng.integers(0, N_TAGS, n)))] for n in sizes]


@pytest.fixture(scope="module", params=[4096, 2], ids=["one segment", "many segments"])
def table(request, spark, corpus):
    long_sequences.FAN = 2
    rows = [
        (s, i, len(seq[0]), *(column[i] for column in seq)) for s, seq in enumerate(corpus) for i in range(len(seq[0]))
    ]
    schema = "sid long, pos long, len long, word long, pos_tag long, chunk long, tag long"
    result = Q.SequenceTable.from_tokens(spark.createDataFrame(rows, schema), ["sid"], N_TAGS, request.param)
    assert result.has_long == (request.param == 2)
    return result


def paths(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.sid, r.rank, r.seg)):
        out.setdefault((r.sid, r.rank), (r.score, []))[1].extend(r.path)
    return out


@pytest.mark.parametrize("k,use_loss", [(1, True), (1, False), (4, True)])
def test_k_best_equals_brute_force(table, corpus, k, use_loss):
    found = paths(Q.decode(table, W, k, use_loss))
    expected = {}
    for s, seq in enumerate(corpus):
        for rank, (score, tags) in enumerate(brute(seq, k, use_loss)):
            expected[(s, rank + 1)] = (score, list(tags))
    assert found == expected  # dyadic weights: scores and ties are exact, short sequences have fewer rows


def test_values_and_gradients(table, corpus):
    for mu in (None, 1.5):
        values = {r.sid: r for r in Q.sequence_values(table, W, mu, 4).collect()}
        expected = np.zeros(DIM)
        for s, seq in enumerate(corpus):
            best = brute(seq, 4 if mu else 1)
            weights = project([b[0] for b in best], mu) if mu else np.ones(1)
            gold = W @ phi(seq, seq[3])
            assert values[s].hinge == pytest.approx(best[0][0] - gold, abs=1e-9) and values[s].hinge >= 0
            assert values[s].smooth == pytest.approx(sum(u * b[0] for u, b in zip(weights, best)) - gold, abs=1e-9)
            expected += sum(u * phi(seq, b[1]) for u, b in zip(weights, best)) - phi(seq, seq[3])
        found = np.zeros(DIM)
        for r in Q.gradient_sum(table, W, mu, 4).collect():
            found[r.idx] = r.value
        np.testing.assert_allclose(found, expected, atol=1e-9)


def test_linear_minimizers_counts_scores_and_predictions(table, corpus):
    psi = {s: [np.zeros(DIM), 0.0] for s in range(len(corpus))}
    for r in Q.linear_minimizers(table, W).collect():
        psi[r.sid][0][r.idx] += r.val
        psi[r.sid][1] += r.loss
    counts = {s: np.zeros(DIM) for s in psi}
    for r in Q.feature_counts(table, DIM).collect():
        counts[r.sid][r.idx] += r.n
    scores = {r.sid: r.score for r in Q.sequence_score(table, W).collect()}
    distance = {r.sid: r.distance for r in Q.hamming(Q.predict_tags(table, W), ["sid"]).collect()}
    for s, seq in enumerate(corpus):
        worst = brute(seq, 1)[0][1]
        np.testing.assert_array_equal(psi[s][0], phi(seq, seq[3]) - phi(seq, worst))
        assert psi[s][1] == sum(a != b for a, b in zip(worst, seq[3]))
        np.testing.assert_array_equal(counts[s], phi(seq, seq[3]))
        assert scores[s] == pytest.approx(W @ counts[s])
        assert distance[s] == sum(a != b for a, b in zip(brute(seq, 1, False)[0][1], seq[3]))


def test_edges_add_up_to_the_sequence_score(table, corpus):
    edges = {(r.sid, r.pos, r.y1, r.y): r.score for r in Q.edge_scores(table, W).collect()}
    for s, seq in enumerate(corpus):
        tags = seq[3]
        total = sum(edges[(s, i, tags[i - 1] if i else -1, tags[i])] for i in range(len(tags)))
        assert total == pytest.approx(W @ phi(seq, tags))


def test_gradient_is_the_derivative_of_the_smoothed_value(table, corpus):
    """The smoothed value omits mu/2 |u|^2, so the test adds that term back before differentiating."""
    mu, k, seq = 1.5, 3**5, corpus[4]

    def value(w):
        global W
        kept, W = W, w
        try:
            best = [b[0] for b in brute(seq, k)]
            u = project(best, mu)
            return u @ best - mu / 2 * u @ u - w @ phi(seq, seq[3])
        finally:
            W = kept

    best = brute(seq, k)
    u = project([b[0] for b in best], mu)
    gradient = sum(a * phi(seq, b[1]) for a, b in zip(u, best)) - phi(seq, seq[3])
    direction = np.random.default_rng(0).normal(size=DIM)
    eps = 1e-5
    slope = (value(W + eps * direction) - value(W - eps * direction)) / (2 * eps)
    assert slope == pytest.approx(gradient @ direction, rel=1e-4)


TRAINED = {}


def test_training_does_not_depend_on_the_segment_size(table):
    loss = SequenceLoss(table, DIM, k=3)
    run = Run("svrg", [L2Penalty(0.1)], {"learning_rate": 0.1, "smoothing_coefficient": 1.0})
    steps = fit(loss, run, num_passes=1, mode="minibatch", n_buckets=2, logging=False).w
    blocks = fit_frank_wolfe(loss, Run("bcfw", [L2Penalty(0.1)]), num_passes=1, n_buckets=2, logging=False).w
    inner = fit(loss, run, num_passes=2, partitions=2, logging=False).w
    value = loss.value_means([W])[0]
    loss.release()
    assert all(np.abs(w).max() > 0 for w in (steps, blocks, inner))
    first = TRAINED.setdefault("first", (steps, blocks, inner, value))
    for a, b in zip(first, (steps, blocks, inner, value)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_prediction_on_a_stream(spark, table, corpus, tmp_path):
    path = str(tmp_path / "rows")
    table.df.write.parquet(path)
    stream = spark.readStream.schema(table.df.schema).parquet(path)
    predicted = predict_stream(stream, ["sid"], N_TAGS, W)
    query = predicted.writeStream.format("memory").queryName("predicted").trigger(availableNow=True).start()
    if table.has_long:  # a part of a sequence is refused, never decoded wrongly
        with pytest.raises(StreamingQueryException, match="part of a long sequence"):
            query.awaitTermination(120)
        return
    query.awaitTermination(120)
    found = sorted(map(tuple, spark.sql("select * from predicted").collect()))
    assert found == sorted(map(tuple, Q.predict_tags(table, W).collect())) and found
