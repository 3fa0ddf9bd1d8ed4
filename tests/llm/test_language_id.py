import zlib

from structweave.llm.language_id import has_letter, identify, language_stage, op10_language_id, train, training_rows

from .conftest import EDGES, by_id


def test_held_out_accuracy_and_digest(spark, sf):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_language_id(spark, sf).collect()
    assert len(rows) == len(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_training_is_sparse_reproducible_and_calibrated(spark, sf):
    docs = training_rows(spark.read.parquet(f"{sf}/documents.parquet"))
    a, b = train(docs, per_label=40), train(docs.repartition(7), per_label=40)
    assert a.labels == b.labels and (a.weights == b.weights).all() and a.temperature == b.temperature
    assert a.sparsity > 0.5 and 0.5 <= a.temperature <= 20


def test_edges(spark, sf, edge_docs, no_docs):
    learned = training_rows(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text", "lang")
    found = identify(edge_docs, learned).collect()
    assert len(found) == len(EDGES)
    of = by_id(identify(edge_docs.where("doc_id is not null"), learned))
    assert {of[i].lang_pred for i in (1, 2, 3, 6)} == {"und"} and {of[i].score for i in (1, 2, 3, 6)} == {0.0}
    assert of[4].lang_pred != "und"
    assert {r.lang_pred for r in identify(edge_docs, no_docs).collect()} == {"und"}
    assert identify(no_docs, learned).count() == 0
    assert has_letter("1é") and not has_letter("1 .") and not has_letter(None)


def test_stage_keeps_what_is_told(spark, sf, edge_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = language_stage(spark, docs, sf)
    assert kept.schema.names == docs.schema.names and kept.count() == docs.count()
    left = [r.doc_id for r in language_stage(spark, edge_docs, sf).collect()]
    assert not {1, 2, 3, 6} & set(left) and left.count(8) == 2
    assert language_stage(spark, edge_docs, sf).schema.names == edge_docs.schema.names


def test_labels_of_long_texts_and_ids_that_many_rows_share(spark, monkeypatch):
    """A label with long texts only is learned; rows without an id, copies and one hot id keep the sample within its bound."""
    from structweave.llm import language_id

    long = [(k, "zyx wvu tsr " * 2_000, "yy") for k in range(40)]
    short = [(None, f"the cat and dog {'abcdefgh'[k % 8]}{'klmnop'[k % 6]} sat", "xx") for k in range(900)] + [(5, "le chat et le chien", "zz")] * 900
    docs = spark.createDataFrame(long + short, "doc_id bigint, text string, lang string").repartition(5)
    seen = []
    original = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda data, *a: seen.append(len(data)) or original(data, *a))
    model = train(docs, per_label=50)
    assert model.labels == ["xx", "yy", "zz"]
    # 24 different rows without an id, 10 long ones, 1 hot one; every fifth calibrates.
    assert seen == [28]
    found = identify(docs.where("lang = 'yy'"), docs).collect()
    assert {r.lang_pred for r in found} == {"yy"}


def test_ftrl_against_the_plain_recursion():
    """Weights of a few steps, coordinate by coordinate."""
    import math

    import numpy as np

    from structweave.llm.language_id import BITS, ftrl

    r = np.random.default_rng(3)
    data = [(np.sort(r.choice(40, 6, replace=False)), r.random(6), int(r.integers(3))) for _ in range(25)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    weights, bias = ftrl(data, 3, 2, alpha, beta, l1, l2)
    assert weights.shape == (1 << BITS, 3) and not weights[40:].any() and (weights == 0).any() and np.isfinite(bias).all()

    def told(x):
        at, v, _ = x
        z = v @ weights[at] + bias
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    loss = -np.mean([math.log(told(x)[x[2]]) for x in data])
    assert loss < 0.7 * math.log(3)
