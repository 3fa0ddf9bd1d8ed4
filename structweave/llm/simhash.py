"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 bits; the mask of a nonzero vector v keeps the positions whose vector has
an odd product with v. Any set of up to radius positions leaves some v orthogonal to all its vectors, so two fingerprints
within the radius agree on at least one of the 2^(radius + 1) - 1 masks: no pair is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, discard, keyed, saved
from .components import components

SEED = 42
WIDTH = 64
#: Shingles of a long text are counted in parts of this many.
PART = 1 << 16


def covering_masks(width: int, radius: int, offset: int = 0) -> list[int]:
    """Masks over ``width`` bits; positions take the nonzero vectors in turn, so masks keep about half the bits each."""
    vectors = (1 << (radius + 1)) - 1
    marks = [1 + (i + offset) % vectors for i in range(width)]
    return [sum(1 << i for i, m in enumerate(marks) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_spans(text: bytes, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words joined by spaces, and where each shingle starts and ends in them."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    n = max(1, len(starts) - words + 1)
    return joined, starts[:n], ends[-n:] if n > 1 else ends[-1:]


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    joined, starts, ends = shingle_spans(text, words)
    for s in range(0, len(starts), PART):
        pairs = zip(starts[s : s + PART].tolist(), ends[s : s + PART].tolist(), strict=True)
        yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in pairs), np.uint64)


def fingerprint(text: bytes, words: int, words_out: int = 1) -> list[int]:
    """``words_out`` times 64 bits, each set if in over half the hashes; a text without words has all bits 0.

    The first 64 bits come from the hashes themselves, further ones from mixing them.
    """
    counts, total = np.zeros((words_out, WIDTH), np.int64), 0
    for h in shingle_hashes(text, words):
        total += len(h)
        for k in range(words_out):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h = h ^ (h >> np.uint64(29))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    return [sum(1 << int(i) for i in np.flatnonzero(c * 2 > total)) for c in counts]


def fingerprints(docs: DataFrame, words: int = 3, words_out: int = 1) -> DataFrame:
    """(_id, _hash, f0, f1, ...) per row of a keyed table."""
    schema = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), *((f"f{k}", pa.int64()) for k in range(words_out))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("_id", "_hash", "_text")), strict=True):
                    yield i, h, *map(_signed, fingerprint((t or "").encode(), words, words_out))

        yield from batched(rows(), schema)

    return docs.mapInArrow(run, "_id bigint, _hash bigint, " + ", ".join(f"f{k} bigint" for k in range(words_out)))


def links_within_two(points: DataFrame) -> DataFrame:
    """Edges (a, b) that join all 64-bit ``f`` (distinct) at two or fewer differing bits, and no others.

    Fingerprints that agree on a mask are candidates. Within such a bucket, two are linked if and only if they share a
    point at distance one or less from both, so each emits itself and its neighbours over the bits that the mask leaves
    out, and a shared point makes the edge: linear in the bucket's size, exact for buckets of any size.
    """
    masks = covering_masks(WIDTH, 2)
    options = F.array(*[F.struct(F.lit(v).alias("v"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("k")) for v, m in enumerate(masks)])
    # Bits that a mask leaves out, as an array per mask; zero stands for the fingerprint itself.
    free = [F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(WIDTH) if not m >> i & 1]) for m in masks]
    keyed_points = points.select("f", F.explode(options).alias("o")).select("f", "o.v", "o.k")
    full = keyed_points.groupBy("v", "k").agg(F.count("f").alias("n")).where("n > 1").select("v", "k")
    members = keyed_points.join(full, ["v", "k"]).select("v", "f")
    flips = F.element_at(F.array(*free), F.col("v") + 1)
    near = members.select("f", F.explode(flips).alias("flip")).select("f", F.col("f").bitwiseXOR(F.col("flip")).alias("z")).distinct()
    hubs = near.groupBy("z").agg(F.min("f").alias("hub"), F.count("f").alias("n")).where("n > 1").select("z", "hub")
    return near.join(hubs, "z").where("f <> hub").select(F.col("f").alias("a"), F.col("hub").alias("b")).distinct()


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) per row: fingerprints at two or fewer differing bits link.

    Null and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one shingle of
    all of them. ``component_id`` is the least id reachable, null ids last; rows that repeat are rows of one component.
    Only ids and texts are read, so other columns of any name do no harm.
    """
    prints = saved(fingerprints(keyed(docs, id_col, text_col), words).select("_id", F.col("f0").alias("f")), "simhash")
    classes = saved(prints.groupBy("f").agg(F.min("_id").alias("first")), "simhash-classes")
    found = components(links_within_two(classes.select("f")))
    joined = classes.join(found.withColumnRenamed("node", "f"), "f", "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = saved(joined.join(least, "component").select("f", "component_id"), "simhash-components")
    out = prints.join(ids, "f")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# --- Near-duplicate texts: fingerprints first, then all pairs by prefixes of shingle sets; the sets themselves decide


def word_key(text: str | None) -> int:
    """A hash of the lower-cased words; equal for texts that differ in case or white space only."""
    return _signed(xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), SEED))


def near_rows(texts: DataFrame) -> DataFrame:
    """(_id, _hash, _key, f) per row of a keyed table: the hash of its words and its SimHash fingerprint."""
    schema = pa.schema([(c, pa.int64()) for c in ("_id", "_hash", "_key", "f")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seen: dict[int, int] = {}  # copies are counted once
            for batch in batches:
                for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("_id", "_hash", "_text")), strict=True):
                    key = word_key(t)
                    f = seen.get(key)
                    if f is None:
                        f = _signed(fingerprint((t or "").encode(), SIMHASH_WORDS)[0])
                        if len(seen) < SEEN:
                            seen[key] = f
                    yield i, h, key, f

        yield from batched(rows(), schema)

    return texts.mapInArrow(run, "_id bigint, _hash bigint, _key bigint, f bigint")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of keys that join all classes whose fingerprints are within two bits, as ``group`` links them."""
    prints = rows.select("_key", "f").distinct()
    classes = saved(prints.groupBy("f").agg(F.min("_key").alias("first")), "simhash-classes")
    equal = prints.join(classes, "f").select(F.col("first").alias("a"), F.col("_key").alias("b"))
    ends = [classes.select(F.col("f").alias(x), F.col("first").alias(f"k{x}")) for x in ("a", "b")]
    near = links_within_two(classes.select("f")).join(ends[0], "a").join(ends[1], "b").select("ka", "kb")
    both = equal.unionAll(near).where("a <> b")
    return saved(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(_key, s): sorted distinct 32-bit shingle hashes of each text."""
    schema = pa.schema([("_key", pa.int64()), ("s", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k, t in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                    parts = [(h >> np.uint64(32)).astype(np.uint32) for h in shingle_hashes((t or "").encode(), words)]
                    yield k, np.unique(np.concatenate(parts)).tobytes() if parts else b""

        yield from batched(rows(), schema, lambda r: len(r[1]) + 64)

    return docs.select("_key", "_text").mapInArrow(run, "_key bigint, s binary").dropDuplicates(["_key"])


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-6


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
        keep = [_alike(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least) for a, b in sets]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: Words of a shingle under the fingerprints, as ``group`` takes them.
SIMHASH_WORDS = 3
#: Texts of one shingle that are held against one another in a task; more are dealt over pairs of blocks.
BLOCK = 1_000
#: Shingles that a block of them has in all.
BLOCK_SHINGLES = 4_000_000
#: One text of so many is read to learn which shingles are common, and so many of these are told apart.
SAMPLED, COMMON = 16, 1 << 16
#: Keys that a task remembers.
SEEN = 1 << 18


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    parts = list(shingle_hashes((text or "").encode(), words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """At most ``COMMON`` shingles, the most frequent last, of a sample of texts by their hashes."""
    schema = pa.schema([("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("_text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(t, words).view(np.int64))], schema=schema)

    some = texts.where(F.pmod(F.xxhash64("_hash", F.lit(5)), F.lit(SAMPLED)) == 0).dropDuplicates(["_hash"])
    counted = some.select("_text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("h").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    return np.asarray(found["h"], np.int64)[::-1].view(np.uint64)


def prefix_entries(texts: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(h, _key, size, pos): the first shingles of each text, in an order that is the same for all texts.

    Sets of a Jaccard similarity of ``similarity`` share one of their first size - ceil(similarity size) + 1 shingles,
    whatever the order (prefix filter); rare ones come first, so that few texts meet.
    """
    schema = pa.schema([("h", pa.int64()), ("_key", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash = np.argsort(sent.value)
        known = sent.value[by_hash]
        seen: set[int] = set()  # spares most of the work for copies; the rest go with the repeated entries
        for batch in batches:
            for t in batch.column("_text").to_pylist():
                k = word_key(t)
                s = distinct_shingles(t, words) if k not in seen else ()
                if not len(s):
                    continue
                if len(seen) < SEEN:
                    seen.add(k)
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, by_hash[at] + 1, 0)
                first = s[np.lexsort((s, rank))][: len(s) - math.ceil(similarity * len(s) - 1e-6) + 1]
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(n, k)), pa.array(np.full(n, len(s), np.int32)), pa.array(np.arange(n, dtype=np.int32))], schema=schema)

    return texts.select("_text").mapInArrow(run, "h bigint, _key bigint, size int, pos int")


#: 64-bit words of a bitmap, and of the folded one that is looked at first.
BITMAP, FOLDED = 64, 16


def bitmap(cell: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount(cell, minlength=64 * BITMAP) & 1)


def bitmaps(docs: DataFrame, words: int) -> DataFrame:
    """(_key, bits): per text, for each of 4,096 cells, whether an odd number of its distinct shingles falls there.

    A shingle that only one of two texts has changes one cell, so their sets differ in at least as many shingles as their
    bitmaps in cells: what the bitmaps rule out is ruled out.
    """
    schema = pa.schema([("_key", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k, t in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                    cell = (distinct_shingles(t, words) >> np.uint64(52)).astype(np.int64)
                    yield k, bitmap(cell).tobytes()

        yield from batched(rows(), schema, lambda r: 8 * BITMAP + 64)

    return docs.select("_key", "_text").mapInArrow(run, "_key bigint, bits binary").dropDuplicates(["_key"])


class _Blocks:
    """The texts of one shingle in two blocks, and their pairs that sizes, places and bitmaps leave open."""

    def __init__(self, p: int, q: int, rows: list[pa.RecordBatch], similarity: float):
        self.key, self.size, self.pos, self.g, mine = (
            np.concatenate([np.asarray(r.column(c)) for r in rows]) for c in ("_key", "size", "pos", "g", "mine")
        )
        self.similarity = similarity
        self.p, self.q = p, q
        self.left, self.right = (np.flatnonzero(mine == x) for x in (p, q))

    def see(self, bits: np.ndarray) -> None:
        coarse = np.bitwise_xor.reduce(bits.reshape(len(bits), -1, FOLDED), axis=1)  # cells joined: a bound as well
        self.cells = coarse, bits

    def open(self, i: int, group: np.ndarray) -> np.ndarray:
        """What text ``i`` may be similar to among the later ones that ``group`` sets apart from it."""
        size, pos, similarity = self.size, self.pos, self.similarity
        j = self.right if self.p != self.q else self.right[self.right > i]
        j = j[group[i] != group[j]]
        both = (size[i] + size[j]) * (similarity / (1 + similarity))
        j = j[np.minimum(size[i] - pos[i], size[j] - pos[j]) >= both - 1e-6]
        for cells in self.cells:
            apart = np.bitwise_count(cells[i] ^ cells[j]).sum(axis=1, dtype=np.int64)
            j = j[apart <= (size[i] + size[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6]
        return j


def _by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[pa.RecordBatch]]]:
    """((h, p, q), its rows), in order."""
    at, held = None, []
    for batch in batches:
        columns = [np.asarray(batch.column(c)) for c in ("h", "p", "q")]
        cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                now = tuple(int(c[a]) for c in columns)
                if now != at:
                    if held:
                        yield at, held
                    at, held = now, []
                held.append(batch.slice(a, b - a))
    if held:
        yield at, held


PLACED = ["h", "p", "q", "mine", "_key", "size", "pos", "g"]


def _open_texts(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The texts that have an open pair, no more rows than came in; ``partner`` makes a forest that spans these pairs."""
    for (_, p, q), rows in _by_blocks(batches):
        blocks = _Blocks(p, q, rows, similarity)
        blocks.see(np.frombuffer(b"".join(x for r in rows for x in r.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP))
        tree, is_open, held = blocks.g.copy(), np.zeros(len(blocks.g), bool), []
        for i in blocks.left:
            j = blocks.open(i, blocks.g)
            if not len(j):
                continue
            is_open[i], is_open[j] = True, True
            others, at = np.unique(tree[j], return_index=True)
            at, others = at[others != tree[i]], others[others != tree[i]]
            if len(others):
                held.append(np.stack([np.full(len(at), i), j[at]]))
                tree[np.isin(tree, others)] = tree[i]
        if held:
            # Each of these pairs joins two trees, so they are fewer than the open texts: one goes beside each text.
            ends = np.concatenate(held, axis=1)
            listed = np.flatnonzero(is_open)
            one, two = np.zeros((2, len(listed)), np.int64)
            one[: ends.shape[1]], two[: ends.shape[1]] = blocks.key[ends[0]], blocks.key[ends[1]]
            whole = pa.Table.from_batches([r.select(PLACED) for r in rows]).take(pa.array(listed)).combine_chunks()
            none = pa.array(np.arange(len(listed)) >= ends.shape[1])
            pair = [pa.array(np.minimum(one, two), mask=np.asarray(none)), pa.array(np.maximum(one, two), mask=np.asarray(none))]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in whole.columns), *pair], [*PLACED, "a", "b"])


def _spanning_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the similar texts of two blocks by their sets: fewer than the rows that came in."""
    for (_, p, q), rows in _by_blocks(batches):
        blocks = _Blocks(p, q, rows, similarity)
        sets = [np.frombuffer(x, np.uint32) for r in rows for x in r.column("s").to_pylist()]
        blocks.see(np.stack([bitmap(s >> np.uint32(20)) for s in sets]).view(np.uint64))
        tree, ends = blocks.g.copy(), []
        for i in blocks.left:
            for j in blocks.open(i, tree):
                if tree[i] != tree[j] and _alike(sets[i], sets[j], similarity):
                    ends.append(sorted((int(blocks.key[i]), int(blocks.key[j]))))
                    tree[tree == tree[j]] = tree[i]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends)], ["a", "b"])


def near_groups(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows are (_id, _hash, _key, f), groups are (_key, component) of texts alike.

    Equal word sequences are one class, represented by the hash ``_key`` of their words. Classes link if and only if the
    sets of their ``words``-word shingles have a Jaccard similarity of ``similarity``; groups are the components.

    SimHash comes first: classes whose fingerprints are within two bits are held against one another and make the first
    groups. Fingerprints of similar texts may differ in more bits, so the others are found by prefixes: every such pair
    shares a shingle of them, at places that leave room for the overlap. Each class is held against two others per shared
    shingle that lie in other groups, then every pair that still lies in different groups. A bitmap of each text rules out
    nearly all that are not similar; a forest of what is left is verified, and where that leaves different groups the sets
    themselves are compared in the task, which sends on one link per two groups joined, never all pairs.
    """
    texts = keyed(docs, id_col, text_col)
    rows = saved(near_rows(texts), "near-rows")
    one_text = rows.groupBy("_key").agg(F.min("_hash").alias("_hash"))

    def texts_of(keys: DataFrame) -> DataFrame:
        return texts.join(keys.join(one_text, "_key").select("_key", "_hash"), "_hash").select("_key", "_text")

    def alike(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("_key")).unionAll(pairs.select(F.col("b").alias("_key"))).distinct()
        sets = saved(shingle_sets(texts_of(wanted), words), "near-sets")
        both = pairs.join(sets.select(F.col("_key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("_key").alias("b"), F.col("s").alias("sb")), "b")
        links = saved(both.select("a", "b", "sa", "sb").mapInArrow(lambda it: _similar(it, similarity), "a bigint, b bigint"), "near-links")
        discard(sets)
        return links

    def grouped(df: DataFrame, groups: DataFrame, key: str, out: str) -> DataFrame:
        member = groups.select(F.col("node").alias(key), F.col("component").alias("_component"))
        return df.join(member, key, "left").withColumn(out, F.coalesce("_component", key)).drop("_component")

    def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
        """Groups that links join. Steps run over links between groups, not over their members."""
        between = grouped(grouped(links, groups, "a", "ga"), groups, "b", "gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        met = components(between)
        least = met.select(F.col("node").alias("component"), F.col("component").alias("_least"))
        moved = groups.join(least, "component", "left").select("node", F.coalesce("_least", "component").alias("component"))
        return saved(moved.unionAll(met.join(groups, "node", "left_anti")), "near-groups")

    by_print = fingerprint_pairs(rows)
    groups = saved(components(alike(by_print)), "near-groups")

    entries = prefix_entries(texts, words, similarity, common_shingles(texts, words)).repartition("h").dropDuplicates(["h", "_key"])
    same = Window.partitionBy("h")
    n = F.count("h").over(same)
    blocks = F.ceil(F.greatest(n / BLOCK, F.sum("size").over(same) / BLOCK_SHINGLES)).cast("int")
    numbered = entries.withColumn("n", n).withColumn("blocks", blocks).where("n > 1").drop("n")
    shared = saved(numbered, "near-shared")

    def fits(x: str, y: str) -> Column:
        """Whether two texts that share a shingle there can be similar, if it is the first they share."""
        sx, sy, px, py = F.col(f"{x}.size"), F.col(f"{y}.size"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
        return F.least(sx - px, sy - py) >= (sx + sy) * (similarity / (1 + similarity)) - 1e-6

    def distinct_pairs(found: DataFrame) -> DataFrame:
        one, two = F.col("x._key"), F.col("y._key")
        pairs = found.where((one != two) & fits("x", "y")).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
        apart = grouped(grouped(pairs, groups, "a", "ga"), groups, "b", "gb").where("ga <> gb")
        return saved(apart.select("a", "b").join(by_print, ["a", "b"], "left_anti"), "near-pairs")

    item = F.struct("_key", "size", "pos")
    hubs = shared.groupBy("h").agg(F.min(item).alias("y"))
    beside = shared.select(item.alias("x"), F.lag(item).over(same.orderBy("size", "_key")).alias("y")).where("y is not null")
    some = distinct_pairs(shared.select("h", item.alias("x")).join(hubs, "h").select("x", "y").unionAll(beside))
    groups = joined(groups, alike(some))

    # Texts of a common shingle are dealt over pairs of blocks; every two meet in one of them. A task holds two blocks.
    mixed = saved(distinct_buckets(grouped(shared, groups, "_key", "g")), "near-mixed")
    bits = saved(bitmaps(texts_of(mixed.select("_key").distinct()), words), "near-bitmaps")
    mine = F.pmod(F.xxhash64("_key", F.lit(3)), F.col("blocks")).cast("int")
    dealt = mixed.join(bits, "_key").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    square = dealt.select("h", F.least("mine", "theirs").alias("p"), F.greatest("mine", "theirs").alias("q"), "mine", "_key", "size", "pos", "g", "bits")
    kinds = "h bigint, p int, q int, mine int, _key bigint, size int, pos int, g bigint, a bigint, b bigint"
    opened = saved(in_blocks(square).mapInArrow(lambda it: _open_texts(it, similarity), kinds), "near-open")
    for t in (mixed, bits, shared):
        discard(t)
    forest = saved(opened.where("a is not null").select("a", "b").distinct().join(some, ["a", "b"], "left_anti"), "near-pairs")
    groups = joined(groups, alike(forest))

    # Where the forest had pairs that are not similar, others of its texts may be: their sets are compared in place.
    again = grouped(opened.drop("g", "a", "b"), groups, "_key", "g")
    rest = saved(distinct_buckets(again, "p", "q"), "near-rest")
    sets = saved(shingle_sets(texts_of(rest.select("_key").distinct()), words), "near-sets")
    held = in_blocks(rest.join(sets, "_key")).select(*PLACED, "s")
    more = saved(held.mapInArrow(lambda it: _spanning_links(it, similarity), "a bigint, b bigint").distinct(), "near-links")
    for t in (opened, rest, sets, some, forest, by_print):
        discard(t)
    return rows, joined(groups, more)


def distinct_buckets(placed: DataFrame, *block: str) -> DataFrame:
    """The rows of shingles (or blocks of them) whose texts lie in two groups or more; of those that hold the same texts, one.

    A passage that texts share gives as many shingles as it has words, all with the same texts. The one that comes first
    for all stays, where each text has its first place among them; so no pair is lost.
    """
    at = ["h", *block]
    row = [c for c in placed.columns if c not in (*at, "pos")]
    same = [F.bit_xor(F.xxhash64(*row, F.lit(k))).alias(f"same{k}") for k in (1, 2)]
    sums = [F.min("g").alias("g1"), F.max("g").alias("g2"), F.count("g").alias("n"), F.sum("pos").alias("first"), *same]
    mixed = placed.groupBy(*at).agg(*sums).where("g1 <> g2")
    kept = mixed.groupBy(*block, "n", "same1", "same2").agg(F.min_by("h", "first").alias("h"))
    return placed.join(kept.select(*at), at, "left_semi")


def in_blocks(placed: DataFrame) -> DataFrame:
    return placed.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id (of equal ids and words, one row)."""
    rows, groups = near_groups(docs, "doc_id", "text")
    member = groups.withColumnRenamed("node", "_key")
    placed = rows.join(member, "_key", "left").select("_id", "_key", "_hash", F.coalesce("component", "_key").alias("group"))
    kept = placed.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "_hash")).alias("least"))
    keep = saved(kept.select(F.col("least._id").alias("_keep_id"), F.col("least._hash").alias("_keep_hash")), "near-kept")
    hashed = docs.withColumn("_near_hash", F.xxhash64(F.col("text").cast("string")))
    same = hashed["doc_id"].cast("bigint").eqNullSafe(keep["_keep_id"]) & (hashed["_near_hash"] == keep["_keep_hash"])
    # Rows that share an id and the words are copies; one stays. Different texts under one id, or under none, all stay.
    return hashed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_near_hash"]).drop("_near_hash")
