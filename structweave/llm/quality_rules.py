"""Quality rules: gradient-boosted trees over statistics of a document, some of them monotonic.

``statistics`` measures whole texts, ``fit_rules`` trains trees on labelled documents, ``judge`` applies both base rules
and trees to every document. The trees are flattened into node arrays; a batch of rows walks down all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table

#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"[#*$%&|<>]"
WINDOW = 5

#: Counts that a document is measured by, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_echoes")
#: What the trees see, and how the verdict may depend on it: 1 never falls, -1 never rises, 0 any way.
FEATURES = {
    "words": 0, "chars_a_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "words_a_line": 0, "upper": 0,
    "digits": 0, "marks": -1, "distinct": 0, "echoes": -1,
}


def _word_ids(text: bytes) -> np.ndarray:
    """A number per word, the same for equal words, in order of first appearance."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in SPACES:
            end += 1
        out.append(np.fromiter((seen.setdefault(w, len(seen)) for w in text[at:end].split()), np.int64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number per pair, the same for equal pairs."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1]


def _repeated(ids: np.ndarray) -> int:
    """Words inside windows of five words that are found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    pairs = _ranks(ids[:-1], ids[1:])
    fours = _ranks(pairs[:-2], pairs[2:])
    fives = _ranks(fours[:n], ids[4:])
    often = np.bincount(fives)[fives] > 1
    depth = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    return int((np.cumsum(depth[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ids = _word_ids(raw)
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    points = int(bytes_of.sum() - bytes_of[0x80:0xC0].sum())
    symbols = int(bytes_of[list(set(SYMBOLS[1:-1]))].sum())
    return (
        len(ids), points - int(bytes_of[list(SPACES)].sum()), symbols, len(lines) - len(set(lines)), _repeated(ids), len(lines),
        int(bytes_of[0x41:0x5B].sum()), int(bytes_of[0x30:0x3A].sum()), int(bytes_of[0x21] + bytes_of[0x3F]),
        int(ids.max(initial=-1)) + 1, int((ids[1:] == ids[:-1]).sum()),
    )


def features(measured: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS."""
    m = {name: measured[:, k].astype(np.float64) for k, name in enumerate(COUNTS)}
    words, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    return np.stack(
        [
            m["n_words"], m["word_chars"] / words, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words,
            m["n_words"] / lines, m["n_upper"] / chars, m["n_digits"] / chars, m["n_marks"] / words, m["n_distinct"] / words,
            m["n_echoes"] / words,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Trees:
    """Boosted trees as node arrays; a leaf points at itself, so every row takes ``depth`` steps."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds per row."""
        total = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            at = np.tile(self.roots, (len(x), 1))
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at].sum(axis=1)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def _best_split(grad: np.ndarray, hess: np.ndarray, signs: np.ndarray, ridge: float, least: float):
    """(gain, feature, bin, left value, right value) from sums per (feature, bin); None without a gain.

    A split on a monotonic feature counts only if the two leaf values stand the right way round.
    """
    g, h = np.cumsum(grad, axis=1)[:, :-1], np.cumsum(hess, axis=1)[:, :-1]
    all_g, all_h = grad.sum(axis=1)[:, None], hess.sum(axis=1)[:, None]
    left, right = -g / (h + ridge), -(all_g - g) / (all_h - h + ridge)
    gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
    gain[(h < least) | (all_h - h < least) | (signs[:, None] * (right - left) < 0)] = 0
    if gain.size == 0 or gain.max() <= 1e-9:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), float(left[f, b]), float(right[f, b])


def boost(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
    ridge: float = 1.0, least: float = 1.0,
) -> Trees:
    """Logistic boosting on histograms. ``y`` may be fractions. With one kind of label only, or none, there are no trees.

    Below a split on a monotonic feature, values stay on their side of the middle of the two leaf values, so the sum of
    trees is monotonic in that feature.
    """
    share = float(y.mean()) if len(y) else 1.0
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if not 0 < share < 1:
        start, trees = (4.0 if share >= 1 else -4.0), 0
    else:
        start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T] if trees else []
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1) if trees else x
    width = max((len(e) + 1 for e in edges), default=1)
    flat = binned + np.arange(x.shape[1]) * width if trees else binned

    def node(value: float) -> int:
        k = len(nodes["feature"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", rate * value)):
            nodes[name].append(v)
        return k

    def grow(rows: np.ndarray, k: int, level: int, low: float, high: float) -> None:
        if level == depth or not len(rows):
            return
        cells, size = flat[rows].ravel(), x.shape[1] * width
        sums = [np.bincount(cells, np.repeat(v[rows], x.shape[1]), size).reshape(-1, width) for v in (grad, hess)]
        found = _best_split(*sums, signs, ridge, least)
        if found is None:
            return
        _, f, b, left, right = found
        left, right = (min(max(v, low), high) for v in (left, right))
        middle = (left + right) / 2
        goes_left = binned[rows, f] <= b
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(signs[f])]
        kids = node(left), node(right)
        nodes["feature"][k], nodes["threshold"][k] = f, float(edges[f][b])
        nodes["left"][k], nodes["right"][k] = kids
        for kid, part, (a, z) in zip(kids, (rows[goes_left], rows[~goes_left]), bounds):
            grow(part, kid, level + 1, a, z)

    total = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        roots.append(node(0.0))
        first = roots[-1]
        grow(np.arange(len(y)), first, 0, -np.inf, np.inf)
        total = total + _flatten(0.0, [first], nodes, depth).margin(x)
    return _flatten(start, roots, nodes, depth)


def _flatten(start: float, roots: list[int], nodes: dict[str, list], depth: int) -> Trees:
    whole = {k: np.array(v, np.int64 if k in ("feature", "left", "right") else np.float64) for k, v in nodes.items()}
    return Trees(start, np.array(roots, np.int64), depth=depth, **whole)


_MEASURED = pa.schema([("_id", pa.int64()), *((name, pa.int64()) for name in COUNTS)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, COUNTS) of every whole text; a null text counts as empty, a null or repeated id is kept as it is."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("_id"), batch.column("_text")
            yield from batched(((ids[k].as_py(), *counts(texts[k].as_py())) for k in range(batch.num_rows)), _MEASURED)

    return rows.mapInArrow(run, "_id bigint, " + ", ".join(f"{name} bigint" for name in COUNTS))


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", max_rows: int = 20_000, **options) -> Trees:
    """Trees from labelled documents: about ``max_rows`` ids at most, chosen by a hash of the id, reach the driver.

    Several labels of an id are averaged; of several texts under one id that with the least counts is taken, so an id
    that many rows share costs one row. Null labels and null ids are not labels. Without labels of both kinds there are
    no trees and every document gets the same probability.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
    each = known.groupBy(F.col(id_col).cast("bigint").alias("_label_of")).agg(F.avg(F.col(quality_col).cast("double")).alias("_y"))
    share = min(1.0, max_rows / max(each.count(), 1))
    chosen = each.where(F.pmod(F.xxhash64("_label_of"), F.lit(1 << 32)) < int(share * (1 << 32)))
    own = docs.select(F.col(id_col).cast("bigint").alias("_doc"), F.col(text_col).alias("_words"))
    # About max_rows ids of 16 bytes: bounded by the parameter.
    picked = own.join(F.broadcast(chosen.select("_label_of")), own["_doc"] == F.col("_label_of"), "left_semi")
    one = statistics(picked, "_doc", "_words").groupBy("_id").agg(F.min(F.struct(*COUNTS)).alias("_c"))
    rows = one.join(F.broadcast(chosen), F.col("_id") == F.col("_label_of")).select("_id", "_y", "_c.*").toPandas()
    rows = rows.sort_values("_id", kind="stable")
    signs = np.array(list(FEATURES.values()))
    return boost(features(rows[list(COUNTS)].to_numpy(np.int64)), rows["_y"].to_numpy(np.float64), signs, **options)


def judge(docs: DataFrame, rules: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, COUNTS, base_failed, probability, kept) of every row.

    The base rules fail a document of fewer than 10 words and one with over a fifth of its words in repeated windows;
    null and empty texts have no words and fail. The rest is kept from a probability of 0.5. Rows that repeat, or share
    an id, are judged each on its own. An empty table gives an empty result.
    """
    schema = pa.schema([*_MEASURED, ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = np.stack([np.asarray(batch.column(name)) for name in COUNTS], axis=1)
            n_words, repeats = measured[:, COUNTS.index("n_words")], measured[:, COUNTS.index("n_repeat_words")]
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            p = rules.probability(features(measured))
            columns = [*batch.columns, pa.array(failed), pa.array(p), pa.array(~failed & (p >= 0.5))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = ", ".join(f"{name} bigint" for name in COUNTS)
    return statistics(docs, id_col, text_col).mapInArrow(run, f"_id bigint, {kinds}, base_failed boolean, probability double, kept boolean")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; trees trained on ``labels.quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    found = judge(docs, rules)
    base = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")]
    return found.select(F.col("_id").alias("doc_id"), *base)
