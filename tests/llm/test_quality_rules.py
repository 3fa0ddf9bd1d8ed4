"""Quality rules: base counts against a plain count, trees against their definition, verdicts on held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from structweave.llm import quality_rules as q
from structweave.llm.common import table

from .conftest import LONG, by_id, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def texts():
    r = random.Random(5)
    for n in (0, 1, 4, 5, 6, 9, 10, 11, 30, 200):
        for vocabulary in (2, 3, 50):
            words = [f"w{r.randrange(vocabulary)}{r.choice(['', '#', 'é', '\x1c', ' ', '!!'])}" for _ in range(n)]
            yield "".join(w + r.choice([" ", "\n", "\t\x0b", "\r\n", "\x0c "]) for w in words)
    yield from (None, "", " \n\t", "[a] b [a] b [a] b", "a\n a\na\n\n\na", LONG + "\n" + LONG, "漢字 \U0001f600 " * 40)


def test_counts(monkeypatch):
    for text in texts():
        assert q.counts(text)[:5] == plain(text), text
    monkeypatch.setattr(q, "PIECE", 7)  # seams inside words and windows
    for text in texts():
        if not text or len(text) < 5_000:
            assert q.counts(text)[:5] == plain(text), text


def test_trees_walk_like_their_nodes():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(400, 3)), r.integers(0, 2, 400).astype(float)
    trees = q.boost(x, y, np.zeros(3, int), trees=7, depth=3, least=0.1)

    def walk(row):
        total = trees.start
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        return 1 / (1 + np.exp(-total))

    assert len(trees.roots) == 7 and np.allclose(trees.probability(x), [walk(row) for row in x])
    loss = lambda t: -np.mean(np.log(np.where(y == 1, t.probability(x), 1 - t.probability(x))))
    assert loss(trees) < loss(q.boost(x, y, np.zeros(3, int), trees=1, depth=3, least=0.1)) < np.log(2)


@pytest.mark.parametrize("sign", [1, -1])
def test_monotonic(sign):
    r = np.random.default_rng(2)
    x = r.uniform(size=(2_000, 2))
    y = (r.uniform(size=2_000) < 0.5 + 0.4 * np.sin(9 * x[:, 0]) * (x[:, 1] - 0.5)).astype(float)
    trees = q.boost(x, y, np.array([sign, 0]), trees=40, depth=4)
    free = q.boost(x, y, np.array([0, 0]), trees=40, depth=4)
    steps = np.linspace(-0.1, 1.1, 300)
    falls = 0
    for other in np.linspace(0, 1, 25):
        grid = np.stack([steps, np.full(300, other)], axis=1)
        assert (sign * np.diff(trees.margin(grid)) >= -1e-12).all()
        falls += (sign * np.diff(free.margin(grid)) < 0).sum()
    assert falls and len(np.unique(trees.margin(x))) > 10


def test_labels_of_one_kind_or_none():
    x = np.arange(10.0)[:, None]
    for y, verdict in ((np.ones(10), True), (np.zeros(10), False), (np.zeros(0), True)):
        trees = q.boost(x[: len(y)], y, np.zeros(1, int))
        assert not len(trees.roots) and ((trees.probability(x) >= 0.5) == verdict).all()


def test_held_out_labels(spark, sf):
    """Trees from three quarters of the labels tell the rest."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    rules = q.fit_rules(docs, labels.where(part != 0))
    told = q.judge(docs, rules).join(labels.where(part == 0), F.col("_id") == F.col("doc_id")).toPandas()
    assert len(told) > 60
    clean = told[(told.quality == 1) & ~told.base_failed]
    bad = told[told.quality == 0]
    assert clean.kept.mean() >= 0.97 and (~bad.kept).mean() >= 0.9


def test_query(spark, sf):
    found = q.op13_quality_rules(spark, sf)
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = by_id(found)
    docs = table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        row, base = rows[d.doc_id], plain(d.text)
        assert tuple(row)[1:6] == base
        assert row.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (row.base_failed and row.kept)


def test_edges(spark, edge_docs, no_docs, written):
    labels = spark.createDataFrame([(8, 1, 0), (8, 0, 0), (11, 1, None), (None, 1, 0), (12, None, 0), (10, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = q.op13_quality_rules(spark, written(documents=edge_docs, labels=labels)).collect()
    assert len(found) == edge_docs.count()
    assert all(row.base_failed and not row.kept for row in found if row.n_words == 0) and sum(row.doc_id is None for row in found) == 2
    assert len({tuple(row) for row in found if row.doc_id == 8}) == 1
    nothing = written(documents=no_docs, labels=labels.limit(0))
    assert q.op13_quality_rules(spark, nothing).count() == 0
    unlabelled = q.op13_quality_rules(spark, written(documents=edge_docs, labels=labels.limit(0))).collect()
    assert all(row.kept != row.base_failed for row in unlabelled)


def test_bounded_sample(spark):
    """An id that many rows share and repeated labels cost one training row; about max_rows ids are chosen."""
    docs = spark.createDataFrame([(k % 3_000 if k % 2 else 7, " ".join(prose(k, 12, 30))) for k in range(6_000)], "doc_id bigint, text string")
    labels = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    seen = []
    original = q.boost
    q.boost = lambda x, y, *a, **k: seen.append(len(y)) or original(x, y, *a, **k)
    try:
        q.fit_rules(docs, labels.unionAll(labels), max_rows=500)
    finally:
        q.boost = original
    assert 150 < seen[0] < 600
