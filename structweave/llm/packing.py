"""Sequence packing by non-negative least squares over length combinations.

Texts are tokenized and cut at multiples of the window; what is left of each text is one piece shorter than the window.
Shallow combinations of lengths that fill a window exactly are enumerated, their repeat counts are the non-negative
least-squares solution against the histogram of lengths, rounded down to what there is. Of the rest, pieces longer than half
a window are cut at half a window, and all is packed greedily.
All of this works on a histogram of at most ``window`` counts; Spark numbers the pieces of each length and deals them out.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_within
from .common import batched, keyed, saved

WINDOW = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = ("<|endoftext|>", 50256)
SEPARATOR = 0
DEPTH = 3
#: Slices in which the pieces of one length are numbered, so that a length that many texts share is no single task.
SLICES = 256
_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The byte-level encoder of a rank file; a file of the public tokenizers by name, any other by path."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([END_OF_TEXT]))
    return _ENCODERS[vocabulary]


_PIECES = pa.schema([*((c, pa.int64()) for c in ("_id", "_hash", "start")), ("length", pa.int32()), *((c, pa.int64()) for c in ("crc", "crc_head", "crc_tail", "tokens"))])


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """(_id, _hash, start, length, crc, crc_head, crc_tail, tokens): each keyed text's ids and a closing 0, cut at multiples
    of the window. A piece longer than half a window may be cut there, so both parts have their check sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)

        def rows():
            for batch in batches:
                for i, h, text in zip(*(batch.column(c) for c in ("_id", "_hash", "_text")), strict=True):
                    ids = np.append(encode.encode_to_numpy(text.as_py() or "", allowed_special="all"), SEPARATOR).astype("<u4")
                    data = memoryview(ids).cast("B")
                    for s in range(0, len(ids), window):
                        n = min(window, len(ids) - s)
                        parts = [zlib.crc32(data[4 * a : 4 * b]) for a, b in ((s, s + n), (s, min(s + n, s + window // 2)), (min(s + n, s + window // 2), s + n))]
                        yield i.as_py(), h.as_py(), s, n, *parts, len(ids)

        yield from batched(rows(), _PIECES)

    return docs.mapInArrow(run, "_id bigint, _hash bigint, start bigint, length int, crc bigint, crc_head bigint, crc_tail bigint, tokens bigint")


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` of the given lengths (falling, padded with 0) that add up to the window."""
    known = np.zeros(window + 1, bool)
    known[lengths] = True
    found = [[window, *[0] * (depth - 1)]] if known[window] else []
    stack = [((), window, window)]
    while stack:
        parts, rest, most = stack.pop()
        if rest <= most and rest <= window and known[rest] and parts:
            found.append([*parts, rest, *[0] * (depth - len(parts) - 1)])
        if len(parts) < depth - 1:
            for n in lengths[(lengths <= most) & (lengths < rest) & (lengths * (depth - len(parts)) >= rest)].tolist():
                stack.append(((*parts, n), rest - n, n))
    return np.array(found, np.int64).reshape(-1, depth)


def solve(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of least |A x - histogram|^2, by accelerated projected gradient; column j of A counts the lengths of pattern j."""
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    target = histogram.astype(np.float64).copy()
    target[0] = 0

    def used(v):
        total = np.bincount(patterns.ravel(), np.repeat(v, patterns.shape[1]), len(histogram))
        total[0] = 0
        return total

    # A bound of the largest eigenvalue of A'A: the most of (pattern's lengths x patterns per length).
    step = 1.0 / max(1.0, patterns.shape[1] * used(np.ones(len(patterns))).max())
    y, t = x, 1.0
    for _ in range(rounds):
        error = used(y) - target
        error[0] = 0
        new = np.maximum(0.0, y - step * error[patterns].sum(axis=1))
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / grown * (new - x)
        x, t = new, grown
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths of a sequence, how many such), and how many pieces of each length stay whole; the others, all longer than
    half a window, are cut there. Every piece that the histogram counts, or both its parts, is in exactly one sequence."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = combinations(np.flatnonzero(left[:window]), window, depth)
    counts = solve(patterns, left)

    def take(parts: tuple[int, ...], wanted: int) -> int:
        kinds, each = np.unique(parts, return_counts=True)
        n = int(min(wanted, (left[kinds] // each).min()))
        if n > 0:
            left[kinds] -= each * n
            out.append((parts, n))
        return n

    if left[window]:
        take((window,), int(left[window]))
    for share in (lambda x: np.floor(x), lambda x: np.ceil(x)):  # round down first, then up as far as pieces last
        for j in np.argsort(-counts, kind="stable"):
            wanted = int(share(counts[j] + 1e-9))
            if wanted > 0:
                take(tuple(int(p) for p in patterns[j] if p), wanted)
    half = window // 2
    whole = histogram - np.where(np.arange(window + 1) > half, left, 0)
    cut = left[half + 1 :].copy()
    left[half + 1 :] = 0
    left[half] += cut.sum()
    left[1 : 1 + len(cut)] += cut
    while left.any():  # the longest, then what fits best into the rest, as often as all of it lasts
        parts, rest = [], window
        have = left.copy()
        while True:
            fits = np.flatnonzero(have[: rest + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            # A shorter part may leave a rest that another fills exactly.
            if parts and n < rest:
                exact = [int(k) for k in fits[::-1][:64] if rest - k > 0 and have[rest - k] > (rest - k == k)]
                n = exact[0] if exact else n
            parts.append(n)
            have[n] -= 1
            rest -= n
        take(tuple(parts), int(left.sum()))
    return out, whole


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece.

    A null or empty text is one piece, its closing 0. Rows that repeat are packed as often as they come. No text, no row.
    """
    cut = saved(pieces(keyed(docs, id_col, text_col), window, vocabulary), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``window`` lengths
        histogram[r["length"]] = r["count"]
    slots = []
    taken, sequence = np.zeros(window + 1, np.int64), 0
    sequences, whole = plan(histogram, window)
    for parts, n in sequences:
        offset = 0
        for length in parts:
            # The k-th of a length among equal parts of one pattern: each part has its own stretch of numbers.
            slots.append((length, int(taken[length]), sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    slots.sort()
    starts = np.array([(length << 44) + first for length, first, *_ in slots], np.int64)
    first, base, offset = (np.array([s[k] for s in slots], np.int64) for k in (1, 2, 3))

    # Parts of cut pieces are numbered after the whole pieces of their length, length by length of what was cut.
    half, cuts = window // 2, histogram - whole
    head_from = whole[half] + np.cumsum(cuts) - cuts
    tail_from = np.zeros(window + 1, np.int64)
    tail_from[half:] = whole[: window - half + 1]
    tail_from[window] = 0  # full windows are never cut

    numbered = number_within(
        cut.withColumn("_order", F.xxhash64("_id", "_hash", "start")), ["length"], ["_slice", "_order", "_id", "_hash", "start"],
        F.pmod("_order", F.lit(SLICES)), "rank", "of_length",
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, start, length, rank, tokens = (b.column(c).to_numpy(zero_copy_only=False) if c != "_id" else b.column(c) for c in ("_id", "start", "length", "rank", "tokens"))
            is_cut = rank >= whole[length]
            rest = np.where(is_cut, rank - whole[length], 0)
            one = (np.where(is_cut, half, length), np.where(is_cut, head_from[length] + rest, rank))
            crc = np.where(is_cut, b.column("crc_head").to_numpy(), b.column("crc").to_numpy())
            c = np.flatnonzero(is_cut)
            two = (length[c] - half, tail_from[length[c]] + rest[c])
            size, nth = (np.concatenate(x) for x in zip(one, two, strict=True))
            at = np.searchsorted(starts, (size << 44) + nth, "right") - 1
            order = np.concatenate([np.arange(len(length)), c])
            columns = [
                i.take(pa.array(order)), pa.array(np.concatenate([start, start[c] + half])), pa.array(size), pa.array(np.concatenate([crc, b.column("crc_tail").to_numpy()[c]])),
                pa.array(tokens[order]), pa.array(base[at] + nth - first[at]), pa.array(offset[at]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    chosen = numbered.select("_id", "start", F.col("length").cast("bigint").alias("length"), "crc", "crc_head", "crc_tail", "tokens", "rank")
    return chosen.mapInArrow(placed, f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, by sequence."""
    return pack(docs)
