"""Benchmark decontamination by spaced seeds.

A seed hashes the words at the positions that a fixed mask keeps, so substitutions at the other positions do no harm.
Hashes of the benchmark and of the corpus are joined; around each hit the aligned words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, keyed, saved
from .words import word_hashes

#: Kept positions of each mask. Whatever fifth (rounded down) of 13 to 25 aligned words is substituted, at least one mask
#: has a hit. A longer stretch falls into parts of 13 to 25 words, of which one has no more than its fifth substituted.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 2, 6, 8, 9), (0, 1, 3, 7, 10, 11))
OVERLAP = 13
SIMILARITY = 0.8
FILTER_BITS = 24


def uncovered(masks=MASKS, window: int = OVERLAP, substitutions: int = 2) -> list[tuple[int, ...]]:
    """Substitution patterns in a window that no mask gets past."""
    placed = [{s + p for p in m} for m in masks for s in range(window - max(m))]
    return [c for c in combinations(range(window), substitutions) if not any(p.isdisjoint(c) for p in placed)]


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks for an item of under ``OVERLAP`` words, first and last word equal.

    The words between are dealt over one part more than may be substituted, so one part is free of substitutions.
    """
    parts = int(length * (1 - SIMILARITY) + 1e-9) + 1
    inner = range(1, length - 1)
    return sorted({tuple(sorted({0, length - 1, *inner[p::parts]})) for p in range(parts)})


def seeds(words: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray]]:
    """(mask number, hash per start) for each mask that fits."""
    for k, mask in enumerate(masks):
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        h = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1, np.uint64)
        for p in mask:
            h = (h ^ words[p : p + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        yield k, h


_SEEDS = pa.schema([("k", pa.int32()), ("h", pa.int64()), ("item", pa.int64()), ("offset", pa.int32()), ("words", pa.binary())])


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words): the word hashes of each benchmark item; items without words are left out, null texts too."""
    schema = pa.schema([("item", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                    w = word_hashes((t or "").encode())
                    if len(w):
                        yield i, w.tobytes()

        yield from batched(rows(), schema, lambda r: len(r[1]) + 64)

    return keyed(items, id_col, text_col).mapInArrow(run, "item bigint, words binary")


def item_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(k, h, item, offset, words). An item of under ``OVERLAP`` words takes the masks of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, data in zip(b.column("item").to_pylist(), b.column("words").to_pylist(), strict=True):
                    w = np.frombuffer(data, np.uint64)
                    for k, h in seeds(w, masks):
                        if (k < len(MASKS)) if len(w) >= OVERLAP else k >= len(MASKS) and masks[k][-1] + 1 == len(w):
                            for o, x in enumerate(h.view(np.int64).tolist()):
                                yield k, x, i, o, data

        yield from batched(rows(), _SEEDS, lambda r: len(r[4]) + 64)

    return items.mapInArrow(run, "k int, h bigint, item bigint, offset int, words binary")


def seed_filter(found: DataFrame) -> np.ndarray:
    """A bitmap of 2^FILTER_BITS bits, whatever the benchmark's size, that lets every seed of it through."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    rows = found.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << FILTER_BITS, bool)
    for r in rows.collect():  # at most 2^FILTER_BITS / 32768 rows of 4 KB
        part = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        out[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return np.packbits(out)


_HITS = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("pos", pa.int32()), ("k", pa.int32()), ("h", pa.int64())])


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first word in the item, words, equal words) of the longest stretch with enough equal words, or None if too short."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high <= low:
        return None
    equal = doc[low + diagonal : high + diagonal] == item[low:high]
    score = np.concatenate([[0.0], np.cumsum(equal - SIMILARITY)])
    # The longest a..b that starts and ends with an equal word and has score[b] >= score[a]: from each a to the last b
    # that is high enough, which moves on only.
    ends = np.where(np.concatenate([[False], equal]), score, -np.inf)
    highest = np.maximum.accumulate(ends[::-1])[::-1]
    best = (0, 0)
    b = 0
    for a in np.flatnonzero(equal).tolist():
        b = max(b, a)
        while b < len(equal) and highest[b + 1] >= score[a] - 1e-9:
            b += 1
        # Only an end that is itself high enough counts; from a lower start before, b may lie too far on.
        if b - a > best[1] - best[0] and ends[b] >= score[a] - 1e-9:
            best = (a, b)
    a, b = best
    if not b or b - a < min(OVERLAP, len(item)):
        return None
    return low + a, b - a, int(equal[a:b].sum())


_FOUND = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for i, h, text, tried in zip(*(batch.column(c) for c in ("_id", "_hash", "_text", "tried")), strict=True):
                doc = word_hashes((text.as_py() or "").encode())
                best: dict[int, tuple[int, int, int]] = {}
                for t in tried.as_py():
                    got = overlap(doc, np.frombuffer(t["words"], np.uint64), t["diagonal"])
                    if got:
                        placed = (got[0] + t["diagonal"], *got[1:])
                        # The most equal words win, then the earliest place.
                        best[t["item"]] = max(best.get(t["item"], placed), placed, key=lambda x: (x[2], -x[0]))
                for item, found in sorted(best.items(), key=lambda x: (x[0] is None, x[0])):
                    yield i.as_py(), h.as_py(), item, *found

    yield from batched(rows(), _FOUND)


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_id, _hash, item_id, first_word, n_words, n_equal): the best overlap of each text with each item it overlaps.

    An overlap is a stretch of at least 13 aligned words (all words of a shorter item) of which 0.8 or more are equal, the first and last among them;
    ``first_word`` counts the text's words from 0. Null and empty texts and items overlap nothing; equal rows give equal rows.
    """
    kept = saved(item_words(items, item_id, item_text), "items")
    short = [r[0] for r in kept.select((F.length("words") / 8).cast("int").alias("n")).where(F.col("n") < OVERLAP).distinct().collect()]  # at most twelve lengths
    masks = [*MASKS, *(m for n in sorted(short) for m in short_masks(n))]
    test = saved(item_seeds(kept, masks), "item-seeds")
    passes = docs.sparkSession.sparkContext.broadcast(seed_filter(test))
    texts = keyed(docs, id_col, text_col)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = passes.value, np.uint64(64 - FILTER_BITS)

        def rows():
            for batch in batches:
                for i, x, text in zip(*(batch.column(c) for c in ("_id", "_hash", "_text")), strict=True):
                    for k, h in seeds(word_hashes((text.as_py() or "").encode()), masks):
                        at = (h >> shift).astype(np.int64)
                        for p in np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)) & 1).tolist():
                            yield i.as_py(), x.as_py(), p, k, int(h[p : p + 1].view(np.int64)[0])

        yield from batched(rows(), _HITS)

    found = texts.mapInArrow(hits, "_id bigint, _hash bigint, pos int, k int, h bigint")
    pairs = found.join(test, ["k", "h"]).groupBy("_id", "_hash", "item", (F.col("pos") - F.col("offset")).alias("diagonal")).agg(F.first("words").alias("words"))
    tried = pairs.groupBy("_id", "_hash").agg(F.collect_list(F.struct("item", "diagonal", "words")).alias("tried"))
    null_safe = (F.col("t._id").eqNullSafe(F.col("c._id"))) & (F.col("t._hash") == F.col("c._hash"))
    compared = texts.alias("t").join(tried.alias("c"), null_safe).select("t._id", "t._hash", "t._text", "c.tried")
    return compared.mapInArrow(_verified, "_id bigint, _hash bigint, item_id bigint, first_word bigint, n_words bigint, n_equal bigint")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_overlaps(docs, items)
    return found.select(F.col("_id").alias("doc_id"), "item_id", "first_word", "n_words", "n_equal", (F.col("n_equal") / F.col("n_words")).alias("similarity"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    found = saved(find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("_id", "_hash").distinct(), "contaminated")
    leaks = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"])
    return docs.join(found, leaks, "left_anti")
