"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training: follow-the-regularised-leader with elastic-net penalties on a bounded labelled sample, document frequencies
over all labelled training rows, then temperature calibration on a part of the sample kept out of training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, crc32_of_id

BITS = 17
ORDERS = 3
#: Code points handled at once; longer texts go in pieces, with the n-grams across the seams kept.
PIECE = 1 << 20
#: Texts that a label learns from if it has only long ones, and parts in which the rows of a label are limited first.
FEW, SALTS = 10, 64
UNDETERMINED = "und"
SCALE = 20.0


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: one row per n-gram bucket, already times the inverse document frequency and the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    sparsity: float = field(default=0.0, compare=False)


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 1- to 3-grams of the lower-cased text, runs of other characters than letters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes])
    shift, a, b = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    for start in range(0, len(codes), PIECE):
        part = codes[start : start + PIECE + ORDERS - 1]
        grams = []
        mixed = part
        for order in range(ORDERS):
            count = min(PIECE, len(codes) - start - order)
            if count <= 0:
                break
            mixed = part if order == 0 else (mixed[: len(part) - order] * a) ^ part[order:]
            grams.append(((mixed[:count] + np.uint64(order)) * b * a) >> shift)
        yield np.concatenate(grams).astype(np.intp)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, np.int64)
    seen = np.zeros(1 << BITS, bool)
    rows = 0
    for batch in batches:
        for text in batch.column("_text").to_pylist():
            parts = list(ngram_buckets(text))
            for p in parts:
                seen[p] = True
            df += seen
            for p in parts:
                seen[p] = False
            rows += 1
    if rows:
        hit = np.flatnonzero(df)
        buckets = np.concatenate([[-1], hit])
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.concatenate([[rows], df[hit]]))], names=["bucket", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("t", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])

    def rows():
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "_h", "_t", "_text"))
            for lang, h, t, text in zip(*columns, strict=True):
                at, n = np.unique(np.concatenate(list(ngram_buckets(text))), return_counts=True)
                yield lang, h, t, at.astype(np.int32), n.astype(np.float32)

    yield from batched(rows(), schema, lambda r: 8 * len(r[3]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Weights (buckets x classes) and bias by follow-the-regularised-leader; rows: (buckets, values, class)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            za, na = z[at], n[at]
            w = solved(za, na)
            error = _softmax(x @ w + bias)
            error[y] -= 1.0
            g = x[:, None] * error
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / alpha * w
            n[at] = grown
            bias_n += error * error
            bias -= alpha * error / (beta + np.sqrt(bias_n))
    return solved(z, n), bias


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(t):
        p = _softmax(logits / math.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = math.log(0.5), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _chosen(rows: DataFrame, per_label: int, max_chars: int) -> DataFrame:
    """(lang, _h, _t) of the rows to train on; limited in salted parts first, so that no label is ranked in one task whole."""
    length = F.length("_text")
    over = F.when(length > max_chars, length).otherwise(0).alias("_over")
    narrow = rows.select("lang", "_h", "_t", over).distinct()
    order = ["_over", "_h", "_t"]
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64("_h", "_t"), F.lit(SALTS)))
    first = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= per_label).drop("_rank")
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where((F.col("_rank") <= per_label) & ((F.col("_over") == 0) | (F.col("_rank") <= FEW))).select("lang", "_h", "_t")


def train(
    docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 500, max_chars: int = 20_000,
    epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> LanguageModel | None:
    """Fit on ``docs``; None if no row has a label and a letter.

    Document frequencies count every labelled row. The weights are fitted on at most ``per_label`` different rows (of an
    id and a text) per label, the first by a hash among texts of up to ``max_chars`` code points; every fifth of these only
    calibrates. A label with fewer than FEW such texts also learns from its shortest longer ones, whole, up to FEW in all.
    """
    # Training text is chosen by its hash, never by position; labelled rows without a letter teach nothing.
    rows = docs.select(
        F.col(text).cast("string").alias("_text"), F.col(label).cast("string").alias("lang"), F.xxhash64(F.col(key), F.lit(11)).alias("_h"), F.xxhash64(F.col(text)).alias("_t"),
    )
    rows = rows.where(F.col("lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    counted = rows.select("_text").mapInArrow(_frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    found = counted.toPandas()  # at most one row per bucket
    if not len(found):
        return None
    total = int(found.loc[found["bucket"] == -1, "df"].iloc[0])
    df = np.zeros(1 << BITS)
    known = found[found["bucket"] >= 0]
    df[known["bucket"].to_numpy()] = known["df"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    chosen = F.broadcast(_chosen(rows, per_label, max_chars))  # at most per_label rows per language
    drawn = rows.join(chosen, ["lang", "_h", "_t"])
    # Copies of a row are one example, however many there are.
    sample = drawn.groupBy("lang", "_h", "_t").agg(F.any_value("_text").alias("_text")).select("lang", "_h", "_t", "_text")
    vectors = sample.mapInArrow(_vectors, "lang string, h bigint, t bigint, at array<int>, n array<float>").toPandas()
    vectors = vectors.sort_values(["h", "t"], kind="stable").reset_index(drop=True)
    labels = sorted(set(vectors["lang"]))
    if not labels:
        return None
    data = []
    for at, n, lang in zip(vectors["at"], vectors["n"], vectors["lang"], strict=True):
        at, n = np.asarray(at), np.asarray(n, np.float64)
        data.append((at, n / n.sum() * idf[at] * SCALE, labels.index(lang)))
    del vectors
    fitted, kept = [r for i, r in enumerate(data) if i % 5], data[::5]
    weights, bias = ftrl(fitted or kept, len(labels), epochs, alpha, beta, l1, l2)
    logits = np.array([x @ weights[at] + bias for at, x, _ in kept])
    t = calibrated(logits, np.array([y for *_, y in kept])) if len(labels) > 1 else 1.0
    table = (weights * idf[:, None] * SCALE / t).astype(np.float32)
    return LanguageModel(labels, table, bias / t, t, float((weights == 0).mean()))


def probabilities(model: LanguageModel, text: str) -> np.ndarray:
    total, count = np.zeros(len(model.labels)), 0
    for at in ngram_buckets(text):
        for s in range(0, len(at), PIECE):
            total += model.weights[at[s : s + PIECE]].sum(axis=0, dtype=np.float64)
        count += len(at)
    return _softmax(total / count + model.bias)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the calibrated probability); other columns of these names are replaced.

    A null text, one without a letter, and every text when there is no model: ``und`` with score 0.
    """
    # Plain values: one row of weights per bucket, the same size for every corpus.
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.labels, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value and LanguageModel(*sent.value)
        for batch in batches:
            names, scores = [], []
            for value in batch.column("_for_language").to_pylist():
                if m is None or not has_letter(value):
                    names.append(UNDETERMINED), scores.append(0.0)
                else:
                    p = probabilities(m, value)
                    k = int(p.argmax())
                    names.append(m.labels[k]), scores.append(float(p[k]))
            rest = [i for i, name in enumerate(batch.schema.names) if name != "_for_language"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in rest), "lang_pred", "score"])

    given = docs.drop("lang_pred", "score")
    schema = given.schema.add("lang_pred", "string").add("score", "double")
    return given.withColumn("_for_language", F.col(text).cast("string")).mapInArrow(run, schema)


def identify(docs: DataFrame, train_on: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, learned from ``train_on``."""
    return predict(docs.select("doc_id", F.col("text").alias("_text")), train(train_on), "_text").drop("_text")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & (crc32_of_id("doc_id") % 4 != 2))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, training_rows(docs))
    return out.select("doc_id", (crc32_of_id("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def language_stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Documents whose language is told with a probability of ``least``; those without a letter or below it go."""
    model = train(training_rows(docs))
    names = docs.columns
    # The prediction's columns stay apart from columns of the table that carry the same names.
    packed = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_text"))
    out = predict(packed, model, "_text").where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return out.select("_row.*")
