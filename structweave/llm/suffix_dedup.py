"""Repeated passages by distributed prefix doubling over a sparse suffix array.

A position is repeated if the LENGTH bytes that start there also start anywhere else. Spark ranks positions by rank pairs
at growing offsets and goes on only where a rank is shared:

* Sparse positions. Each window of LENGTH bytes is stood for by the leftmost least RANK-byte string in it, so equal
  windows have the same anchor at the same distance. Consecutive windows with one anchor are a run. The first ranks are
  those of the anchors: a run whose anchor occurs once is unique, and is dropped before its positions are ever listed.
* Doubling. The runs of an anchor form a binary tree over the distance from window to anchor. A node of width w covers
  windows that all contain one string of LENGTH + 1 - w bytes: its rank pair is (rank of the first RANK bytes, rank of
  the RANK bytes at offset LENGTH + 1 - w - RANK). Halving w grows the offset, up to LENGTH - RANK, where the pair ranks
  whole windows. A node with a unique pair is dropped; runs that agree on the bytes of all their windows in a node are
  past the threshold and marked, and one of them goes on for comparison with the rest.

Ranks are 64-bit names of RANK-byte strings, so a pair and its anchor name a string by 192 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, discard, keyed, saved

LENGTH = 200
RANK = 100
#: Window starts handled at once; a longer text goes in overlapping pieces.
PIECE = 1 << 20
LEVELS = (64, 32, 16, 8, 4, 2, 1)

_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """A random value per byte, powers of the multiplier and of its inverse modulo 2^64; made once per worker."""
    if not _POWERS:
        values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
        n = PIECE + LENGTH + 1
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS.append(values)
    return _POWERS


def _rolling(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes; sums modulo 2^64 wrap around as meant."""
    up, down, values = _powers()
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(values[text] * down[: len(text)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * up[: len(text) - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    m, size = h, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, distance, anchor, name) of the runs of each piece; distance: from the first window to its anchor."""
    width = LENGTH - RANK + 1
    for at in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        part = text[at : at + PIECE + LENGTH - 1]
        h = _rolling(np.frombuffer(part, np.uint8), RANK)
        m = _least(h, width)
        cut = np.flatnonzero(m[1:] != m[:-1]) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(m)]])
        first = np.empty(len(start), np.int64)
        for s in range(0, len(start), 4096):  # of the leftmost least string in each run's first window
            block = start[s : s + 4096]
            first[s : s + 4096] = block + (h[block[:, None] + np.arange(width)] == m[block][:, None]).argmax(axis=1)
        again = np.flatnonzero(end > first + 1)  # the anchor's string occurs again while it is the least
        if len(again):
            extra = []
            for r in again.tolist():
                s, e, v = int(start[r]), int(end[r]), m[start[r]]
                places = s + np.flatnonzero(h[s : e + width - 1] == v)
                bounds = np.concatenate([[s], np.minimum(places + 1, e)])
                keep = bounds[1:] > bounds[:-1]
                extra.append(np.stack([bounds[:-1][keep], bounds[1:][keep], places[keep]]))
            whole = np.ones(len(start), bool)
            whole[again] = False
            more = np.concatenate(extra, axis=1)
            start, end, first = (np.concatenate([x[whole], y]) for x, y in zip((start, end, first), more, strict=True))
        names = np.fromiter((xxhash.xxh3_64_intdigest(part[s : e + LENGTH - 1], e - s) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64)
        distance = first - start
        names ^= distance.astype(np.uint64) * np.uint64(_MULTIPLIER)
        yield start + at, end - start, distance, m[start].view(np.int64), names.view(np.int64)


_RUNS = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("s", pa.int64()), ("n", pa.int16()), ("far", pa.int16()), ("v", pa.int64()), ("sk", pa.int64())])


def _list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    count = 0

    def flushed() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, _RUNS.types, strict=True)], schema=_RUNS)

    for batch in batches:
        for i, h, text in zip(*(batch.column(c) for c in ("_id", "_hash", "_text")), strict=True):
            for start, n, far, v, sk in runs((text.as_py() or "").encode()):
                # Null ids become the least number here and in the join that follows.
                held.append((np.full(len(start), i.as_py() if i.is_valid else -(1 << 63)), np.full(len(start), h.as_py()), start, n, far, v, sk))
                count += len(start)
            if count >= 50_000:
                yield flushed()
                held, count = [], 0
    if held:
        yield flushed()


_STRINGS = pa.schema([("v", pa.int64()), ("sk", pa.int64()), ("n", pa.int16()), ("far", pa.int16()), ("b", pa.binary())])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for text, wanted in zip(batch.column("_text"), batch.column("wanted"), strict=True):
                data = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    yield w["v"], w["sk"], w["n"], w["far"], data[w["s"] : w["s"] + w["n"] + LENGTH - 1]

    yield from batched(rows(), _STRINGS, lambda r: len(r[4]) + 64)


def _node_ranks(rows: DataFrame, width: int) -> DataFrame:
    """(v, sk, lo, r1, r2, whole): the rank pair of each node and the rank of the bytes of all its own windows.

    ``b`` starts at distance ``far``; windows of the node have distances lo to lo + width - 1, of which the run has
    those from far - n + 1 to far.
    """
    top = F.least(F.lit(LENGTH - RANK), F.col("lo") + (width - 1))  # no window lies farther from its anchor
    first = F.col("far") - F.col("lo") + 1  # of the bytes common to all the node's windows, from 1
    last = F.col("far") - top + LENGTH  # where they end
    near, far = F.greatest(F.col("lo"), F.col("far") - F.col("n") + 1), F.least(top, F.col("far"))
    own = F.substring(F.col("b"), F.col("far") - far + 1, far - near + LENGTH)
    return rows.select(
        "v", "sk", "lo",
        F.xxhash64(F.substring(F.col("b"), first, F.lit(RANK))).alias("r1"),
        F.xxhash64(F.substring(F.col("b"), last - RANK + 1, F.lit(RANK))).alias("r2"),
        F.xxhash64(own, near, far).alias("whole"), near.alias("near"), far.alias("to"),
    )


def _children(rows: DataFrame, width: int) -> DataFrame:
    """Nodes of half the width in which the run has windows."""
    low = F.col("far") - F.col("n") + 1
    nodes = F.filter(F.array(F.col("lo"), F.col("lo") + width), lambda x: (x <= F.col("far")) & (x + (width - 1) >= low))
    return rows.select("v", "sk", "n", "far", "b", F.explode(nodes).alias("lo"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(_id, _hash, at, n): of each text, n consecutive window starts from ``at`` whose LENGTH bytes occur elsewhere too."""
    listed = saved(texts.mapInArrow(_list_runs, "_id bigint, _hash bigint, s bigint, n smallint, far smallint, v bigint, sk bigint"), "runs")
    shared = listed.groupBy("v").agg(F.count("s").alias("c")).where("c > 1").select("v")
    found = saved(listed.join(shared, "v"), "shared-runs")
    discard(listed)
    place = F.min(F.struct("_id", "_hash", "s", "n", "far")).alias("p")
    distinct = saved(found.groupBy("v", "sk").agg(F.count("s").alias("c"), place), "distinct-runs")
    # Runs equal in all their windows are past the threshold at once.
    marks = [distinct.where("c > 1").select("v", "sk", (F.col("p.far") - F.col("p.n") + 1).cast("int").alias("near"), F.col("p.far").cast("int").alias("to"))]
    mixed = distinct.groupBy("v").agg(F.count("sk").alias("kinds")).where("kinds > 1").select("v")
    wanted = distinct.join(mixed, "v").groupBy("p._id", "p._hash").agg(F.collect_list(F.struct("v", "sk", "p.s", "p.n", "p.far")).alias("wanted"))
    known = texts.withColumn("_id", F.coalesce("_id", F.lit(-(1 << 63))))
    strings = known.join(wanted, ["_id", "_hash"]).select("_text", "wanted").mapInArrow(_strings, "v bigint, sk bigint, n smallint, far smallint, b binary")
    # A row of the input that repeats gives its strings again.
    rows = strings.dropDuplicates(["v", "sk"]).select("v", "sk", F.col("n").cast("int").alias("n"), F.col("far").cast("int").alias("far"), "b", F.lit(0).alias("lo"))
    before: list[DataFrame] = []
    for width in LEVELS:
        now = saved(_children(rows, width), "nodes")
        for done in before:
            discard(done)
        ranks = _node_ranks(now, width)
        node = ["v", "lo", "r1", "r2"]
        kinds = saved(ranks.groupBy(*node, "whole").agg(F.count("sk").alias("c"), F.min("sk").alias("sk")), "kinds")
        same = ranks.join(kinds.where("c > 1").select(*node, "whole"), [*node, "whole"]).select("v", "sk", "near", "to")
        marks.append(saved(same, "marks"))
        before = [now, kinds]
        if width > 1:
            several = kinds.groupBy(*node).agg(F.count("sk").alias("u")).where("u > 1").select(*node)
            on = kinds.join(several, node).select("v", "sk", "lo")
            rows = now.join(on, ["v", "sk", "lo"])
    marked = marks[0]
    for m in marks[1:]:
        marked = marked.unionAll(m)
    spans = marked.groupBy("v", "sk").agg(F.collect_list(F.struct("near", "to")).alias("spans"))
    places = found.join(spans, ["v", "sk"]).select("_id", "_hash", "s", "far", F.explode("spans").alias("x"))
    return places.select("_id", "_hash", (F.col("s") + F.col("far") - F.col("x.to")).alias("at"), (F.col("x.to") - F.col("x.near") + 1).alias("n"))


def removed_spans(at: list[int], n: list[int], gap: int = 0) -> list[tuple[int, int]]:
    """Maximal byte spans that the windows cover."""
    spans: list[list[int]] = []
    for s, e in sorted((a, a + k - 1 + LENGTH) for a, k in zip(at, n, strict=True)):
        if spans and s <= spans[-1][1] + gap:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    return [(s, e) for s, e in spans]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, at, n): per text the repeated window starts, as lists; texts without any have no row.

    Null and short texts have none. Rows that repeat, under one id or several, hold each other's bytes, so all are found.
    """
    texts = keyed(docs, id_col, text_col)
    spans = saved(repeated_windows(texts), "repeats")
    return spans.groupBy("_id", "_hash").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))


def _with_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows of ``docs`` as struct ``_row``, with ``_id``, ``_text`` and the lists ``at`` and ``n``."""
    marked = find_repeats(docs, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.withColumn("_hash", F.xxhash64("_text")).join(marked, ["_id", "_hash"], "left")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for i, text, at, n in zip(*(batch.column(c) for c in ("doc_id", "_text", "at", "n")), strict=True):
                data, spans = (text.as_py() or "").encode(), removed_spans(at.as_py() or [], n.as_py() or [])
                kept = _kept(data, spans)
                yield i.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    yield from batched(rows(), _DIGEST, lambda r: 128)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = _with_repeats(docs, "doc_id", "text").select("_row.doc_id", "_text", "at", "n")
    return found.mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a code point that a span touches goes as a whole."""
    return _kept(text.encode(), spans).decode("utf-8", "ignore")


def suffix_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; one of which nothing but white space is left goes. ``n_chars`` follows.

    Documents without repeats stay as they are.
    """
    found = _with_repeats(docs, "doc_id", "text")
    schema = found.select("_row", F.col("_text").alias("_new")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                cut_text(text.as_py() or "", removed_spans(at.as_py(), n.as_py())) if at.is_valid else text.as_py()
                for text, at, n in zip(*(batch.column(c) for c in ("_text", "at", "n")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string())], names=["_row", "_new"])

    cut = found.select("_row", "_text", "at", "n").mapInArrow(run, schema)
    changed = ~F.col("_new").eqNullSafe(F.col("_row.text"))
    out = {c: F.col("_row")[c] for c in docs.columns}
    out["text"] = F.col("_new")
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length("_new")).otherwise(F.col("_row.n_chars"))
    kept = cut.where(~changed | F.col("_new").rlike(r"\S"))
    return kept.select(*[x.cast(docs.schema[c].dataType).alias(c) for c, x in out.items()])
