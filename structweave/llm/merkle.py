"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

Leaves are pieces of the UTF-8 text that end where the content says so (sentence ends, or a hash of the bytes before),
so an edit changes the leaves that it touches and no others. Equal roots mean equal texts; where two trees differ, only
branches with different hashes need to be followed to find the edits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, keyed

#: Sentences longer than this are cut where a hash of SEEN bytes is a multiple of CUT.
LONG, SEEN, CUT = 96, 16, 32
#: A paragraph whose hash is a multiple of this ends its section, as a blank line and a heading do.
SECTION = 8
#: Code points per range of ids that is put in order as a whole, and most ranges.
RANGE_CHARS, RANGES = 16_000_000, 4096


@dataclass(frozen=True)
class Tree:
    """``sections``: per section its hash and paragraphs; per paragraph its hash and leaves; per leaf its hash and size."""

    root: str
    sections: tuple[tuple[int, tuple[tuple[int, tuple[tuple[int, int], ...]], ...]], ...]

    def leaves(self) -> Iterator[tuple[int, int]]:
        for _, paragraphs in self.sections:
            for _, leaves in paragraphs:
                yield from leaves

    def text(self) -> str:
        """The fingerprint as a string: the root, then sections by ';', paragraphs by ',' and leaves by '.'."""
        body = ";".join(",".join(".".join(f"{h & 0xFFFFFFFF:08x}{n:x}" for h, n in leaves) for _, leaves in paragraphs) for _, paragraphs in self.sections)
        return f"{self.root}:{body}"


def _inner(hashes) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little") for h in hashes))


def _ends(data: bytes) -> tuple[list[int], list[int]]:
    """Where leaves end, and which of these places end a paragraph."""
    x = np.frombuffer(data, np.uint8)
    line = x == 10
    stop = (x == 46) | (x == 33) | (x == 63)
    stop[:-1] &= x[1:] == 32
    ends = np.flatnonzero(line | stop) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONG).any():
        # A running mix of the last SEEN bytes: shifted out of the 32 bits after as many steps.
        h = np.zeros(len(x), np.uint32)
        mixed = (x.astype(np.uint32) + 1) * np.uint32(0x9E3779B1)
        for k in range(SEEN):
            h[k:] ^= np.left_shift(mixed[: len(x) - k], np.uint32(k)) ^ np.right_shift(mixed[: len(x) - k], np.uint32(31 - k))
        places = np.flatnonzero((h >> np.uint32(7)) % np.uint32(CUT) == 0) + 1
        owner = np.searchsorted(ends, places)
        places = places[(owner < len(ends)) & (gaps[np.minimum(owner, len(ends) - 1)] > LONG)]
        ends = np.union1d(ends, places)
    return ends.tolist(), (line[ends - 1]).tolist()


def tree(data: bytes) -> Tree:
    """The tree of a text; an empty text has no sections."""
    sections, paragraphs, leaves = [], [], []

    def close_section():
        if paragraphs:
            sections.append((_inner(h for h, _ in paragraphs), tuple(paragraphs)))
            paragraphs.clear()

    if data:
        at = 0
        ends, lines = _ends(data)
        for e, is_line in zip(ends, lines, strict=True):
            if not leaves and data[at : at + 1] == b"#":  # a heading opens a section
                close_section()
            leaves.append((xxhash.xxh3_64_intdigest(data[at:e]), e - at))
            at = e
            if is_line or e == len(data):
                h = _inner(h for h, _ in leaves)
                blank = len(leaves) == 1 and leaves[0][1] == 1 and is_line
                paragraphs.append((h, tuple(leaves)))
                leaves = []
                if blank or h % SECTION == 0:
                    close_section()
        close_section()
    root = hashlib.blake2b(b"".join(h.to_bytes(8, "little") for h, _ in sections), digest_size=16).hexdigest()
    return Tree(root, tuple(sections))


def likeness(a: Tree, b: Tree) -> float:
    """Share of the bytes of both texts in leaves that they have in common, counted as often as both have them; 0 to 1."""
    if a.root == b.root:
        return 1.0
    x, y = Counter(a.leaves()), Counter(b.leaves())
    both = sum(n * min(c, y[h, n]) for (h, n), c in x.items() if (h, n) in y)
    total = sum(n * c for (_, n), c in x.items()) + sum(n * c for (_, n), c in y.items())
    return 2 * both / total if total else 1.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte spans (start, end) of ``a`` whose leaves ``b`` lacks; branches that ``b`` has as a whole are not entered."""
    sections = {h for h, _ in b.sections}
    paragraphs = {h for _, ps in b.sections for h, _ in ps}
    leaves = set(b.leaves())
    out: list[list[int]] = []
    at = 0
    for sh, ps in a.sections:
        for ph, ls in ps:
            for leaf in ls:
                if sh not in sections and ph not in paragraphs and leaf not in leaves:
                    if out and out[-1][1] == at:
                        out[-1][1] += leaf[1]
                    else:
                        out.append([at, at + leaf[1]])
                at += leaf[1]
    return [(s, e) for s, e in out]


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many (or all) first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_range, _last, _id, _hash, _text): rows in order of id within ranges that stay together, each range closed by
    the first row of the next one (``_last``; of the last range: the first row of all).

    Null ids come first. Ranges are cut by quantiles of the ids, so a hot source or a run of ids is no single range; the
    text is shuffled once.
    """
    texts = keyed(docs, id_col, text_col).withColumn("_id", F.coalesce("_id", F.lit(-(1 << 63)))).withColumn("_at", F.col("_id").cast("double"))
    facts = texts.agg(F.sum(F.length("_text")).alias("chars"), F.percentile_approx("_at", [k / RANGES for k in range(1, RANGES)], 100_000).alias("cuts")).first()
    wanted = min(RANGES, max(1, -(-(facts["chars"] or 0) // RANGE_CHARS)))
    every = (facts["cuts"] or [])[RANGES // wanted - 1 :: max(1, RANGES // wanted)]
    cuts = [-float("inf"), *sorted(set(every)), float("inf")]
    placed = Bucketizer(splits=cuts, inputCol="_at", outputCol="_range").transform(texts) if len(cuts) > 2 else texts.withColumn("_range", F.lit(0.0))
    placed = placed.select(F.col("_range").cast("int").alias("_range"), "_id", "_hash", "_text")
    least = placed.groupBy("_range").agg(F.min(F.struct("_id", "_hash")).alias("first")).collect()  # one row per range
    least = sorted((r["_range"], r["first"]["_id"], r["first"]["_hash"]) for r in least)
    closing = [(least[k - 1][0], i, h) for k, (_, i, h) in enumerate(least)]  # the first row closes the last range
    firsts = docs.sparkSession.createDataFrame(closing, "_range int, _id bigint, _hash bigint")
    ends = placed.drop("_range").join(F.broadcast(firsts), ["_id", "_hash"]).dropDuplicates(["_range"])
    columns = ["_range", "_last", "_id", "_hash", "_text"]
    rows = placed.withColumn("_last", F.lit(False)).select(*columns).unionAll(ends.withColumn("_last", F.lit(True)).select(*columns))
    return rows.repartitionByRange(max(1, len(least)), "_range").sortWithinPartitions("_range", "_last", "_id", "_hash")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Null texts are empty. The next of rows that share an id is the other one; a single row is its own next. Equal texts
    have equal fingerprints, whatever their case and spacing; two empty texts are alike with 1.
    """
    schema = pa.schema([
        (id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            before = None
            for batch in batches:
                for part, last, i, text in zip(*(batch.column(c) for c in ("_range", "_last", "_id", "_text")), strict=True):
                    part, text = part.as_py(), text.as_py() or ""
                    now = (part, i.as_py(), text, tree(text.encode()))
                    if before and before[0] == part:
                        _, number, old, old_tree = before
                        new = edited(old, text)
                        new_tree = tree(new.encode())
                        yield (
                            None if number == -(1 << 63) else number, len(old), hashlib.sha256(new.encode()).hexdigest(), old_tree.text(),
                            new_tree.text(), likeness(old_tree, new_tree), likeness(old_tree, now[3]),
                        )
                    before = None if last.as_py() else now

        yield from batched(rows(), schema, lambda r: len(r[3]) + len(r[4]) + 128)

    out = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, out)


def op8_merkle(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
