import numpy as np
import pytest

from structweave.operators import candidates as C
from structweave.plans.losses import CandidateLoss
from structweave.sources import tables

DIM, K, MU = 3, 4, 0.7
W = np.array([0.5, -0.25, 0.125])


@pytest.fixture(scope="module")
def groups():
    """Group 0 holds a third of all rows."""
    rng = np.random.default_rng(5)
    sizes = [120, *rng.integers(1, 12, 40)]
    return [(np.round(rng.random(n) * 8) / 8, rng.integers(-8, 9, (n, DIM)) / 8) for n in sizes]


@pytest.fixture(scope="module")
def df(spark, groups):
    rows = [
        (g, c, float(iou), [float(x) for x in feats])
        for g, (ious, matrix) in enumerate(groups)
        for c, (iou, feats) in enumerate(zip(ious, matrix))
    ]
    return spark.createDataFrame(rows, "group_id long, cand int, iou double, feats array<double>").repartition(7)


def weights(scores, mu):
    x = np.array(scores) / mu
    for k in range(1, len(x) + 1):
        rho = (1 - x[:k].sum()) / k
        if k == len(x) or x[k] + rho <= 0:
            return np.maximum(0, x + rho)


def expected(ious, feats, mu):
    aug = feats @ W + 1 - ious
    gold = int(np.argmax(ious))
    order = np.argsort(-aug, kind="stable")[: (K if mu else 1)]
    u = weights(aug[order], mu) if mu else np.ones(1)
    return aug[order[0]] - aug[gold], u @ aug[order] - aug[gold], u @ feats[order] - feats[gold]


@pytest.mark.parametrize("mu", [None, MU])
def test_operators_and_kernel_agree_with_numpy(df, groups, mu):
    rows = [expected(i, f, mu) for i, f in groups]
    hinge = sorted((r.group_id, r.hinge) for r in (C.smoothed_hinge(df, W, mu, K) if mu else C.hinge(df, W)).collect())
    np.testing.assert_allclose([h for _, h in hinge], [r[0] for r in rows], atol=1e-12)
    sums = C.smoothed_gradient_sum(df, W, mu, K) if mu else C.subgradient_sum(df, W)
    gradient = np.array([r.value for r in sorted(sums.collect(), key=lambda r: r.idx)])
    np.testing.assert_allclose(gradient, sum(r[2] for r in rows), atol=1e-9)
    loss = CandidateLoss(df, DIM, K)
    np.testing.assert_allclose(loss.gradient_means([(W, mu)])[0], gradient / len(groups), atol=1e-9)
    assert loss.value_means([W])[0] == pytest.approx(np.mean([r[0] for r in rows]))
    loss.release()


def test_weights_are_a_projection(df):
    scored = C.score(df, W).select("group_id", "cand", "aug")
    for mu in (0.1, 1.0, 10.0):
        rows = C.simplex_weights(C.top_k(scored, K), mu).collect()
        total = {}
        for r in rows:
            assert r.weight >= 0
            total[r.group_id] = total.get(r.group_id, 0) + r.weight
        assert all(t == pytest.approx(1) for t in total.values())


def test_metrics(df, groups):
    picks = [(i[np.argmax(f @ W)], f @ W, i > 0.5) for i, f in groups]
    loss = CandidateLoss(df, DIM, K, limit=200)
    found = loss.metrics(W)
    assert found["mean_iou"] == pytest.approx(np.mean([p[0] for p in picks]))
    assert found["accuracy"] == pytest.approx(np.mean([p[0] >= 0.5 for p in picks]))
    score = np.concatenate([np.concatenate([s, np.zeros(200 - len(s))]) for _, s, _ in picks])
    label = np.concatenate([np.concatenate([h, np.zeros(200 - len(h))]) for _, _, h in picks])
    precision, seen, hits = 0.0, 0, 0
    for threshold in np.unique(score)[::-1]:
        at = score == threshold
        seen, hits = seen + at.sum(), hits + label[at].sum()
        precision += label[at].sum() / label.sum() * hits / seen
    assert found["average_precision"] == pytest.approx(precision)
    operator = C.micro_average_precision(C.score(df, W), 200).first()[0]
    assert operator == pytest.approx(precision)
    loss.release()


def test_top_k_limits_before_the_shuffle(df):
    plan = C.top_k(C.score(df, W), K)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limit", [5, 1000])
def test_truncation_keeps_stored_order_with_and_without_salting(df, groups, monkeypatch, limit):
    native = {(r.group_id, r.cand): r.cand_id for r in C.truncate(df, limit).collect()}
    assert "WindowGroupLimit" in C.truncate(df, limit)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "NATIVE_LIMIT", 1)
    salted = {(r.group_id, r.cand): r.cand_id for r in C.truncate(df, limit).collect()}
    expected = {(g, c): c for g, (ious, _) in enumerate(groups) for c in range(min(limit, len(ious)))}
    assert native == salted == expected


def test_wide_vectors_use_the_same_rules(spark):
    rng = np.random.default_rng(0)
    dim = 70
    w = rng.normal(size=dim)
    rows = [(i // 5, i % 5, float(rng.random()), [float(x) for x in rng.normal(size=dim)]) for i in range(60)]
    df = spark.createDataFrame(rows, "group_id long, cand int, iou double, feats array<double>")
    found = {(r.group_id, r.cand): r.aug for r in C.score(df, w).collect()}
    assert all(found[(g, c)] == pytest.approx(np.dot(x, w) + 1 - iou) for g, c, iou, x in rows)
    gradient = np.zeros(dim)
    for r in C.subgradient_sum(df, w).collect():
        gradient[r.idx] = r.value
    total = np.zeros(dim)
    for g in range(12):
        part = rows[5 * g : 5 * g + 5]
        best = max(range(5), key=lambda i: np.dot(part[i][3], w) + 1 - part[i][2])
        total += np.array(part[best][3]) - np.array(part[max(range(5), key=lambda i: part[i][2])][3])
    np.testing.assert_allclose(gradient, total, atol=1e-9)


def test_feature_files_ragged_labels_and_libsvm(spark, tmp_path):
    matrix = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "000012_dog.npy", matrix)
    rows = tables.read_feature_matrices(spark, str(tmp_path), 3).orderBy("cand").collect()
    assert [(r.group_id, r["class"], r.cand, r.feats) for r in rows] == [(12, "dog", i, list(m)) for i, m in enumerate(matrix.tolist())]
    ragged = spark.createDataFrame(
        [(1, 1.0, [[0.0, 1.0], [2.0, 3.0]], [[0.0], [1.0]], [0.25, 0.75])],
        "group_id long, label double, boxes array<array<double>>, projected_boxes array<array<double>>, ious array<double>",
    )
    flat = tables.explode_candidates(ragged).orderBy("cand").collect()
    assert [(r.cand, r.box, r.proj_box, r.iou) for r in flat] == [(0, [0.0, 1.0], [0.0], 0.25), (1, [2.0, 3.0], [1.0], 0.75)]
    (tmp_path / "x.libsvm").write_text("1 1:0.5 3:2\n2 2:1\n")
    dense = tables.read_libsvm(spark, str(tmp_path / "x.libsvm"), 3).orderBy("id").collect()
    assert [(r.feats, r.y) for r in dense] == [([0.5, 0.0, 2.0], 1.0), ([0.0, 1.0, 0.0], 0.0)]
