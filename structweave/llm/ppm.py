"""Language-model scores by prediction by partial matching (PPM) over bytes, pretrained on the corpus.

The trie is a table per depth: a path of up to ORDER context symbols and the symbol that follows, with its count. A
symbol is predicted from the longest context that the trie has; an unseen symbol costs an escape (as likely as there are
distinct symbols, method C) to the context one byte shorter, whose counts then leave out the symbols of the longer one.

Counts, trie and costs are Spark tables. Scoring brings to each block of texts (a piece of an input split) just the
costs of the n-grams and words that occur in it, so nothing is broadcast and a task holds one block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, saved

ORDER = 4
#: Bits per symbol: bytes, what stands before a text, and its end. The last symbol of a path is in the lowest bits.
BITS, BEFORE, END = 9, 256, 257
ALPHABET = 257  # what can follow: a byte or the end
#: Code points per block, about.
BLOCK_CHARS = 32_000_000
#: Positions counted at once, and slots of the tables that stand for a set of n-grams.
PIECE, SLOTS = 1 << 20, 21
#: Blocks that a task counts side by side; 32 MB each.
BLOCKS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_key(word: bytes) -> int:
    """Words have negative keys, paths of the trie have others."""
    return -(xxhash.xxh3_64_intdigest(word) >> 1) - 1


#: No word holds a line end.
END_KEY = word_key(b"\n")


def paths(data: bytes) -> Iterator[np.ndarray]:
    """The ORDER + 1 symbols that end at each byte and at the end of a text, packed; in pieces."""
    x = np.empty(len(data) + ORDER + 1, np.uint16)
    x[:ORDER] = BEFORE
    x[ORDER:-1] = np.frombuffer(data, np.uint8)
    x[-1] = END
    for s in range(0, len(data) + 1, PIECE):
        n = min(PIECE, len(data) + 1 - s)
        g = x[s : s + n].astype(np.int64)
        for k in range(1, ORDER + 1):
            g <<= BITS
            g |= x[s + k : s + k + n]
        yield g


def slots(g: np.ndarray) -> np.ndarray:
    return ((g.view(np.uint64) * _MIX) >> np.uint64(64 - SLOTS)).astype(np.intp)


class PathCounts:
    """Counts of distinct paths: a slot holds one path, those that find it taken are sorted."""

    def __init__(self) -> None:
        self.key = np.full(1 << SLOTS, -1, np.int64)
        self.count = np.zeros(1 << SLOTS, np.int64)  # in training texts
        self.more: dict[int, int] = {}

    def add(self, g: np.ndarray, train: bool) -> None:
        at = slots(g)
        free = self.key[at] == -1
        self.key[at[free]] = g[free]
        own = self.key[at] == g
        if train:
            np.add.at(self.count, at[own], 1)
        keys, n = np.unique(g[~own], return_counts=True)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            self.more[k] = self.more.get(k, 0) + (c if train else 0)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths, and their counts in training texts."""
        at = np.flatnonzero(self.key >= 0)
        more = np.array(list(self.more), np.int64), np.array(list(self.more.values()), np.int64)
        return np.concatenate([self.key[at], more[0]]), np.concatenate([self.count[at], more[1]])


_KEYS = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, tuple[PathCounts, Counter, Counter]] = {}

    def emptied():
        for block, (grams, known, other) in blocks.items():
            keys, n = grams.items()
            words = set(known) | set(other)
            for k, c in ((keys, n), (np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter((known[w] for w in words), np.int64, len(words)))):
                for s in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[s : s + 100_000]), block)), pa.array(k[s : s + 100_000]), pa.array(c[s : s + 100_000])], schema=_KEYS)
        blocks.clear()

    for batch in batches:
        for block, train, text in zip(*(batch.column(c) for c in ("block", "train", "_text")), strict=True):
            block, train = block.as_py(), train.as_py()
            if block not in blocks:
                # A split has few blocks; what a task counts of a block at several times is added up with the rest.
                if len(blocks) >= BLOCKS:
                    yield from emptied()
                blocks[block] = PathCounts(), Counter(), Counter()
            data = (text.as_py() or "").encode()
            grams, known, other = blocks[block]
            for g in paths(data):
                grams.add(g, train)
            (known if train else other).update([*data.lower().split(), b"\n"])
    yield from emptied()


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, _id, train, _text): a block is an input split, cut by a hash of the rows where splits are large."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"), (crc32_of_id(id_col) % 7 != 2).alias("train"),
        F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"),
    )
    facts = rows.groupBy("split").agg(F.sum(F.length("_text")).alias("chars")).agg(F.max("chars").alias("chars")).first()
    parts = max(1, -(-(facts["chars"] or 0) // BLOCK_CHARS))
    block = F.xxhash64("split", F.pmod(F.xxhash64("_id", "_text"), F.lit(parts))) if parts > 1 else F.col("split")
    return rows.select(block.alias("block"), "_id", "train", "_text")


def _last(symbols: int, path: str = "g") -> Column:
    return F.col(path).bitwiseAND(F.lit((1 << (BITS * symbols)) - 1))


def trie(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per depth k from 0: (path, n) of k context symbols and the next, and (context, total, kinds, left_out) of contexts.

    ``left_out``: how much the symbols of the context count in the context one symbol shorter.
    """
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(ORDER + 1):
        level = saved(counts.groupBy(_last(k + 1).alias("g")).agg(F.sum("n").alias("n")), "trie")
        rows = level.withColumn("context", F.shiftright("g", BITS))
        if k:
            shorter = out[-1][0].select(F.col("g").alias("short"), F.col("n").alias("m"))
            rows = rows.join(shorter, _last(k) == F.col("short"))
        else:
            rows = rows.withColumn("m", F.lit(0))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("n").alias("kinds"), F.sum("m").alias("left_out"))
        out.append((level, saved(contexts, "contexts")))
    return out


def path_costs(wanted: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, value): log10 of the probability of the last symbol of each path after the others."""
    rows = wanted
    for k, (level, contexts) in enumerate(levels):
        found = level.select(F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
        context = contexts.select(F.col("context").alias(f"c{k}"), F.col("total").alias(f"t{k}"), F.col("kinds").alias(f"d{k}"), F.col("left_out").alias(f"x{k}"))
        rows = rows.join(found, _last(k + 1) == F.col(f"g{k}"), "left").drop(f"g{k}")
        rows = rows.join(context, F.shiftright(_last(k + 1), BITS) == F.col(f"c{k}"), "left").drop(f"c{k}")
    none = F.coalesce(F.col("d0"), F.lit(0))
    cost = F.when(none < ALPHABET, -F.log10(ALPHABET - none)).otherwise(F.lit(0.0))
    for k in range(ORDER + 1):
        # What the longer context excludes; nothing where there is none, or the trie has not seen it.
        total = F.col(f"t{k}") - (F.coalesce(F.col(f"x{k + 1}"), F.lit(0)) if k < ORDER else 0)
        kinds = F.col(f"d{k}") - (F.coalesce(F.col(f"d{k + 1}"), F.lit(0)) if k < ORDER else 0)
        weight = F.nullif(total + kinds, F.lit(0))  # nothing is left where the longer context excludes all
        escaped = F.when(kinds > 0, F.log10(kinds / weight)).otherwise(F.lit(0.0)) + cost
        cost = F.when(F.col(f"t{k}").isNull(), cost).when(F.col(f"n{k}").isNotNull(), F.log10(F.col(f"n{k}") / weight)).otherwise(escaped)
        rows = rows.withColumn(f"cost{k}", cost)
        cost = F.col(f"cost{k}")
    return rows.select("g", cost.alias("value"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Trained on the rows whose crc32 of the id as text is not 2 modulo 7 (a null id counts as the empty text). Null texts
    are empty: one token, the end. Without training rows every word costs 0 and every byte the uniform log10(1/257).
    ``score`` is the log10 probability of the UTF-8 bytes and the end; repeated rows are trained on and scored each.
    """
    rows = blocks_of(docs, id_col, text_col)
    counted = saved(rows.mapInArrow(_count, "block bigint, key bigint, n bigint"), "keys")
    totals = saved(counted.groupBy("key").agg(F.sum("n").alias("n")), "key-counts")
    facts = totals.where("key < 0 and n > 0").agg(F.sum("n").alias("tokens"), F.count("n").alias("kinds")).first()
    tokens, kinds = facts["tokens"] or 0, facts["kinds"]
    floor = float(tokens + kinds + 1)
    known = totals.where("key < 0 and n > 0").select("key", F.log10((F.col("n") + 1) / F.lit(floor)).alias("value"))
    grams = totals.where("key >= 0").select(F.col("key").alias("g"), "n")
    costs = path_costs(grams.select("g"), trie(grams.where("n > 0"))).select(F.col("g").alias("key"), "value")
    values = saved(known.unionAll(costs), "costs")
    needed = counted.select("block", "key").join(values, "key").select("block", "key", "value")
    unknown = math.log10(1 / floor)

    out = pa.schema([
        (id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def scored(texts: pa.Table, costs: pa.Table) -> pa.Table:
        key, value = costs.column("key").to_numpy(), costs.column("value").to_numpy()
        is_word = key < 0
        words = dict(zip(key[is_word].tolist(), value[is_word].tolist(), strict=True))
        g, cost = key[~is_word], value[~is_word]
        at = slots(g)
        table = np.full(1 << SLOTS, -1, np.int32)
        table[at] = np.arange(len(g), dtype=np.int32)
        lost = np.flatnonzero(table[at] != np.arange(len(g)))  # share a slot with another: found by search
        table[at[lost]] = -1
        shared = np.flatnonzero(table[at] == -1)
        shared = shared[np.argsort(g[shared])]
        seen: dict[bytes, float] = {}
        found: list[tuple] = []
        for i, train, text in zip(texts.column("_id").to_pylist(), texts.column("train").to_pylist(), texts.column("_text"), strict=True):
            data = (text.as_py() or "").encode()
            listed = [*data.lower().split(), b"\n"]
            for w in set(listed):
                if w not in seen:
                    seen[w] = words.get(word_key(w), 1.0)  # no log10 probability is above 0
            base = np.fromiter(map(seen.__getitem__, listed), np.float64, len(listed))
            missing = base > 0.5
            base[missing] = unknown
            total = 0.0
            for p in paths(data):
                k = table[slots(p)]
                rest = np.flatnonzero(k < 0)
                if len(rest):
                    k[rest] = shared[np.searchsorted(g[shared], p[rest])]
                total += float(cost[k].sum())
            found.append((i, not train, len(listed), len(listed) - int(missing.sum()), tokens, float(base.sum()), total))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(out), out.types, strict=True)], schema=out)

    schema = f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(scored, schema)


def op9_ppm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
