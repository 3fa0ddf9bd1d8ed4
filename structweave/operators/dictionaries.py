"""Vocabulary and tag dictionaries, and encoding with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import global_index

# Reserved entries and their ids.
UNKNOWN = ("<unk>", 0)
START = ("START", -1)
STOP = ("STOP", -2)
TAG_KINDS = ("pos", "chunk", "tag")

# A dictionary of at most this many rows and bytes of text is broadcast; a larger one is joined in two tiers.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000
# Of the words that are not among the broadcast ones of the vocabulary, so many are looked up in place too.
HOT_WORDS = 10_000
# The other words of the vocabulary mark one bit each; so many rows of 64 bits are broadcast at most.
MARK_ROWS = 1 << 20


def order_key(major: Column, middle: Column, minor: Column) -> Column:
    """One number that sorts like (major, middle, minor); the last two lie in [0, 1e9).

    A decimal keeps the minimum of it in a hash aggregate, where a struct would force a sort.
    """
    billion = F.lit(1_000_000_000).cast("decimal(10,0)")
    inner = middle.cast("bigint") * F.lit(1_000_000_000).cast("bigint") + minor.cast("bigint")
    return (
        (major.cast("decimal(19,0)") * billion).cast("decimal(29,0)") * billion + inner.cast("decimal(19,0)")
    ).cast("decimal(38,0)")


def word_counts(tokens: DataFrame) -> DataFrame:
    """Count per word."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame, order: Column, threshold: int = 1) -> DataFrame:
    """Words with more than ``threshold`` occurrences, ids 1.. by first appearance: (word, id, n).

    Counts and first positions are pre-aggregated before the shuffle; the ids come from a range
    partitioned numbering, so neither hot words nor a large vocabulary end up in one task.
    """
    counts = tokens.withColumn("_order", order).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.min("_order").alias("_first")
    )
    kept = counts.where(F.col("n") > threshold)
    return global_index(kept, [F.col("_first")], "id", start=1).select("word", "id", "n")


def with_reserved_words(vocab: DataFrame) -> DataFrame:
    """Vocabulary plus the reserved rows, which are marked so that they never match a corpus word."""
    reserved = vocab.sparkSession.createDataFrame(
        [(w, i, 0, True) for w, i in (UNKNOWN, START, STOP)], "word string, id bigint, n bigint, reserved boolean"
    )
    return vocab.select("word", "id", "n", F.lit(False).alias("reserved")).unionByName(reserved)


def tag_dictionary(tokens: DataFrame, order: Column) -> DataFrame:
    """Ids 0.. by first appearance for each of the three tag columns: (kind, tag, id).

    One row per distinct tag leaves the aggregate, so the ranking is over the closed tag set.
    """
    combined = tokens.groupBy("pos_tag", "chunk_tag", "tag").agg(F.min(order).alias("_order"))
    stacked = combined.selectExpr("stack(3, 'pos', pos_tag, 'chunk', chunk_tag, 'tag', tag) as (kind, tag)", "_order")
    firsts = stacked.groupBy("kind", "tag").agg(F.min("_order").alias("_first"))
    rank = Window.partitionBy("kind").orderBy("_first", "tag")
    return firsts.select("kind", "tag", (F.row_number().over(rank) - 1).cast("bigint").alias("id"))


def with_reserved_tags(tags: DataFrame) -> DataFrame:
    """Tag dictionary plus START and STOP for each kind."""
    reserved = tags.sparkSession.createDataFrame(
        [(k, t, i, True) for k in TAG_KINDS for t, i in (START, STOP)],
        "kind string, tag string, id bigint, reserved boolean",
    )
    return tags.select("kind", "tag", "id", F.lit(False).alias("reserved")).unionByName(reserved)


def _fits_broadcast(entries: DataFrame, text: str) -> bool:
    size = entries.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES


def encode_words(tokens: DataFrame, vocab: DataFrame, key: Column, out: str = "word_id") -> DataFrame:
    """Replace words by ids, 0 when the word is not in ``vocab``.

    A vocabulary of a checked size is broadcast. Beyond that its most frequent words, as many as may be broadcast, and
    what else of it is frequent in ``tokens``, at most HOT_WORDS words by counting, are looked up where the tokens are. A
    word whose bit no word of the vocabulary has marked is known to be missing there, too; only tokens of the words that are
    left are joined by shuffle. ``key`` is any integer column; it used to salt the tokens that need no lookup and is not
    read, since these stay in place.
    """
    entries = vocab.select(F.col("word").alias("_w"), F.col("id").alias("_id"), F.col("n").alias("_n"))
    if _fits_broadcast(entries, "_w"):
        joined = tokens.join(F.broadcast(entries), F.col("word") == F.col("_w"), "left")
        return joined.withColumn(out, F.coalesce("_id", F.lit(0))).drop("_w", "_id", "_n")
    return _encode_two_tier(tokens, entries, out)


def _by_frequency(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with the highest counts that may be broadcast together, and the others; words of about the same count go together."""
    level = F.floor(4 * F.log2(F.greatest("_n", F.lit(1))))
    sizes = entries.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_w")), F.lit(0)).alias("bytes")
    )
    rows = size = 0
    least = None
    for at in sorted(sizes.collect(), key=lambda r: -r["level"]):
        rows, size = rows + at["rows"], size + at["bytes"]
        if rows > BROADCAST_ROWS or size > BROADCAST_BYTES:
            break
        least = at["level"]
    top = F.lit(False) if least is None else level >= F.lit(least)
    return entries.where(top), entries.where(~top)


def _mark(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(64 * MARK_ROWS))


def _marks(entries: DataFrame) -> DataFrame:
    """The bits that the words mark: (_row, _bits). Written, as it is read with every pass over the tokens."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_at", F.lit(64)).cast("int"))
    marked = entries.select(_mark("_w").alias("_at"))
    return materialize(marked.groupBy(F.shiftright("_at", 6).alias("_row")).agg(F.bit_or(bit).alias("_bits")))


def _with_bits(tokens: DataFrame, marks: DataFrame, at: Column, how: str) -> tuple[DataFrame, Column]:
    """``tokens`` joined with the row of bit ``at`` (null: none), and whether that bit is marked."""
    joined = tokens.withColumn("_at", at).join(F.broadcast(marks), F.shiftright("_at", 6) == F.col("_row"), how)
    return joined, F.coalesce(F.getbit("_bits", F.pmod("_at", F.lit(64)).cast("int")) == 1, F.lit(False))


def _open(tokens: DataFrame, known: DataFrame, marks: DataFrame) -> DataFrame:
    """Tokens whose word may be in the vocabulary though it is not in ``known`` (_hw, _hid): its bit is marked.

    The bits come first: they leave few words to look up. An outer join keeps that order, an anti join would be moved below.
    """
    joined, marked = _with_bits(tokens.where(F.col("word").isNotNull()), marks, _mark("word"), "inner")
    looked_up = joined.where(marked).join(F.broadcast(known), F.col("word") == F.col("_hw"), "left")
    return looked_up.where(F.col("_hw").isNull()).select(*tokens.columns)


def _settled(tokens: DataFrame, known: DataFrame, marks: DataFrame) -> DataFrame:
    """The tokens that ``_open`` leaves out, with ``_hid``, null for words that the vocabulary lacks."""
    found = tokens.join(F.broadcast(known), F.col("word") == F.col("_hw"), "left")
    missed = F.when(F.col("_hw").isNull() & F.col("word").isNotNull(), _mark("word"))
    joined, marked = _with_bits(found, marks, missed, "left")
    return joined.where(~marked).select(*tokens.columns, "_hid")


def _hot_words(tokens: DataFrame, entries: DataFrame, top: DataFrame, marks: DataFrame) -> DataFrame:
    """Words that are looked up in place, with their ids: (_hw, _hid). Written, so that all who read it see the same words."""
    top = top.select(F.col("_w").alias("_hw"), F.col("_id").alias("_hid"))
    counts = word_counts(_open(tokens, top, marks))
    frequent = materialize(counts.orderBy(F.col("n").desc(), "word").limit(HOT_WORDS).select(F.col("word").alias("_hw")))
    known = entries.join(F.broadcast(frequent), F.col("_hw") == F.col("_w")).select("_w", F.col("_id").alias("_hid"))
    ids = frequent.join(F.broadcast(known), F.col("_hw") == F.col("_w"), "left").select("_hw", F.coalesce("_hid", F.lit(0)).alias("_hid"))
    return materialize(top.unionByName(ids))


def _encode_two_tier(tokens: DataFrame, entries: DataFrame, out: str) -> DataFrame:
    top, others = _by_frequency(entries)
    marks = _marks(others)
    hot = _hot_words(tokens, entries, top, marks)
    here = _settled(tokens, hot, marks).withColumn(out, F.coalesce("_hid", F.lit(0))).drop("_hid")
    rest = _open(tokens, hot, marks)
    joined = rest.join(others.select("_w", "_id"), F.col("word") == F.col("_w"), "left")
    return here.unionAll(joined.withColumn(out, F.coalesce("_id", F.lit(0))).drop("_w", "_id"))


def unknown_tags(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of ``tokens`` that the dictionary lacks, with their counts: (kind, tag, n)."""
    combined = tokens.groupBy("pos_tag", "chunk_tag", "tag").agg(F.count(F.lit(1)).alias("_n"))
    stacked = combined.selectExpr("stack(3, 'pos', pos_tag, 'chunk', chunk_tag, 'tag', tag) as (kind, tag)", "_n")
    seen = stacked.groupBy("kind", "tag").agg(F.sum("_n").alias("n"))
    return seen.join(tags.select("kind", "tag"), ["kind", "tag"], "left_anti")


def _tag_entries(tags: DataFrame, kind: str, out: str) -> DataFrame:
    entries = tags.where(F.col("kind") == kind).select(F.col("tag").alias(f"_{kind}"), F.col("id").alias(out))
    return F.broadcast(entries) if _fits_broadcast(entries, f"_{kind}") else entries


def encode_tags(
    tokens: DataFrame, tags: DataFrame, columns: Sequence[tuple[str, str, str]] | None = None
) -> DataFrame:
    """Replace the tag columns by ids; a tag outside the dictionary fails the job and names itself."""
    columns = columns or (("pos", "pos_tag", "pos_id"), ("chunk", "chunk_tag", "chunk_id"), ("tag", "tag", "tag_id"))
    tags = materialize(tags)
    encoded = tokens
    for kind, source, out in columns:
        entries = _tag_entries(tags, kind, "_found")
        encoded = encoded.join(entries, F.col(source) == F.col(f"_{kind}"), "left").drop(f"_{kind}")
        missing = F.raise_error(F.concat(F.lit(f"unknown {kind} tag: "), F.coalesce(F.col(source), F.lit("null"))))
        encoded = encoded.withColumn(out, F.coalesce(F.col("_found"), missing.cast("bigint"))).drop("_found")
    return encoded


def inverse(df: DataFrame, dictionary: DataFrame, name: str, column: str = "id") -> DataFrame:
    """Names for ids: adds ``name`` (word or tag) by looking ``column`` up in a dictionary.

    For tag dictionaries filter on the kind first. Aggregate by id before the look-up where that is possible.
    """
    entries = dictionary.select(F.col("id").alias("_id"), F.col(name).alias(f"_{name}"))
    if _fits_broadcast(entries, f"_{name}"):
        entries = F.broadcast(entries)
    joined = df.join(entries, F.col(column) == F.col("_id"), "left").drop("_id")
    return joined.drop(name).withColumnRenamed(f"_{name}", name)
