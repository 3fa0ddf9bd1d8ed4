"""Column-format token corpora: word, POS, chunk and tag per line, a blank line after each sentence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import stretches

# Fixed value: the line prefix that opens a document.
DOCUMENT_MARKER = "-DOCSTART-"

_SPACE = r"[\s\x1c-\x1f]"


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of splittable text files with a total order: (file, block, line_no).

    A block is one file split (a whole file where it cannot be split); its lines come in order from one task.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def _blank(line: Column) -> Column:
    """Whether a line is white space only; its first character settles most lines without a regular expression."""
    written = F.ascii(F.substring(line, 1, 1)).between(33, 126)
    return F.when(written, False).when(line == "", True).otherwise(line.rlike(f"(?U)^{_SPACE}*$"))


def _fields(line: Column) -> Column:
    """The fields of a token line; lines of ASCII with single spaces need no regular expression."""
    plain = (F.octet_length(line) == F.char_length(line)) & ~line.contains("  ") & ~line.startswith(" ")
    for other in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f":
        plain = plain & ~line.contains(other)
    spaced = F.split(F.regexp_replace(line, f"(?U)^{_SPACE}+", ""), f"(?U){_SPACE}+")
    return F.when(plain, F.split(line, " ")).otherwise(spaced)


class _Block:
    """What a file split says of its lines, read in order: flags, and counts of breaks and tokens so far."""

    def __init__(self, carry: bool = False):
        self.after, self.breaks, self.tokens, self.last = carry, 0, 0, -1

    def take(self, marker: np.ndarray, blank: np.ndarray):
        """(break, token, breaks so far, tokens so far, tokens at the last break or -1) for the next lines."""
        after = np.concatenate([[self.after], marker[:-1]])
        is_break, is_token = ~marker & ~after & blank, ~marker & ~after & ~blank
        breaks, tokens = self.breaks + np.cumsum(is_break), self.tokens + np.cumsum(is_token)
        last = np.maximum.accumulate(np.concatenate([[self.last], np.where(is_break, tokens, -1)]))[1:]
        self.after, self.breaks, self.tokens, self.last = bool(marker[-1]), int(breaks[-1]), int(tokens[-1]), int(last[-1])
        return is_break, is_token, breaks, tokens, last


def number_sentences(lines: DataFrame, marker: str = DOCUMENT_MARKER) -> DataFrame:
    """Mark every line of ``scan_lines`` as token or break and number the sentences.

    A line that starts with ``marker`` and the single line after it are skipped. Any other whitespace line closes a
    sentence. A scan task holds a file split whole and in order, so lines are numbered where they are read and never move:
    a first pass over their flags alone gives one summary row per split, these carry counts from split to split, and a
    second pass numbers the lines. A split whose predecessor ended on a marker gives up its first line.
    """
    flagged = lines.withColumn("_marker", F.col("line").startswith(marker)).withColumn("_blank", _blank(F.col("line")))
    named = flagged.withColumn("_file", F.xxhash64("file"))  # the name itself is long, and would go along with every line
    schema = "_file bigint, block bigint, _nb bigint, _nt bigint, _last bigint, _ends boolean, _fb boolean, _ft boolean"

    def summaries(batches):
        at, block, row = None, None, None
        for batch in batches:
            files, starts = np.asarray(batch.column("_file")), np.asarray(batch.column("block"))
            for a, b in stretches(files, starts):
                now = int(files[a]), int(starts[a])
                if now != at:
                    if block is not None:
                        yield _summary(block, row)
                    at, block, row = now, _Block(), None
                is_break, is_token, *_ = block.take(*(np.asarray(batch.column(c).slice(a, b - a)) for c in ("_marker", "_blank")))
                row = row or (*now, bool(is_break[0]), bool(is_token[0]))
        if block is not None:
            yield _summary(block, row)

    offsets = _block_offsets(named.select("_file", "block", "_marker", "_blank").mapInArrow(summaries, schema))
    numbers = "struct<is_break: boolean, is_token: boolean, sent: bigint, pos: bigint>"

    def number(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        at, block = None, None
        for columns in batches:
            marker, blank, *before = columns[2:]
            files, starts = np.asarray(columns[0]), np.asarray(columns[1])
            parts = []
            for a, b in stretches(files, starts):
                now = int(files[a]), int(starts[a])
                carry, b0, t0, s0 = (c[a].as_py() for c in before)
                if now != at:
                    at, block = now, _Block(carry)
                is_break, is_token, breaks, tokens, last = block.take(*(np.asarray(c.slice(a, b - a)) for c in (marker, blank)))
                parts.append((is_break, is_token, b0 + breaks - is_break, t0 + tokens - np.where(last >= 0, t0 + last, s0) - 1))
            whole = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else [pa.array([], t) for t in _NUMBERS]
            yield pa.StructArray.from_arrays(whole, ["is_break", "is_token", "sent", "pos"])

    # Only flags and offsets go to Python, lines stay. One row per file split is broadcast. What a line gets depends on the
    # lines before it, so no filter may be moved below.
    running = F.arrow_udf(number, numbers).asNondeterministic()
    placed = named.join(F.broadcast(offsets), ["_file", "block"])
    told = placed.withColumn("_told", running("_file", "block", "_marker", "_blank", "_carry", "_b0", "_t0", "_s0"))
    return told.select("file", "block", "line_no", "line", *[F.col(f"_told.{c}").alias(c) for c in ("is_break", "is_token", "sent", "pos")], "n_breaks")


_NUMBERS = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64())


def _summary(block: _Block, row: tuple) -> pa.RecordBatch:
    file, at, first_break, first_token = row
    names = ["_file", "block", "_nb", "_nt", "_last", "_ends", "_fb", "_ft"]
    last = None if block.last < 0 else block.last
    values = [file, at, block.breaks, block.tokens, last, block.after, first_break, first_token]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)


def _block_offsets(summary: DataFrame) -> DataFrame:
    """One row per block: whether its first line falls to a marker before it, and what precedes it."""
    blocks = Window.partitionBy("_file").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    # Whether a line is a marker does not depend on what comes before it, so the carry never chains.
    carried = summary.withColumn("_carry", F.lag("_ends", 1, False).over(blocks)).select(
        "_file",
        "block",
        "_carry",
        (F.col("_carry") & F.col("_fb")).cast("bigint").alias("_lost_b"),
        (F.col("_carry") & F.col("_ft")).cast("bigint").alias("_lost_t"),
        "_nb",
        "_nt",
        "_last",
    )
    net = carried.select(
        "*",
        (F.col("_nb") - F.col("_lost_b")).alias("_net_b"),
        (F.col("_nt") - F.col("_lost_t")).alias("_net_t"),
        F.when(F.col("_nb") > F.col("_lost_b"), F.col("_last") - F.col("_lost_t")).alias("_net_at"),
    )
    before = net.select(
        "*",
        F.coalesce(F.sum("_net_b").over(earlier), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_net_t").over(earlier), F.lit(0)).alias("_t0"),
        F.sum("_net_b").over(Window.partitionBy("_file")).alias("n_breaks"),
    )
    start = F.coalesce(F.max(F.col("_t0") + F.col("_net_at")).over(earlier), F.lit(0))
    return before.select("_file", "block", "_carry", "_b0", "_t0", "n_breaks", start.alias("_s0"))


def sentence_tokens(numbered: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Token rows (file, sent, pos, word, pos_tag, chunk_tag, tag).

    ``strict_reference`` drops a last sentence that no blank line closes; by default it is kept.
    """
    rows = numbered.where("is_token")
    if strict_reference:
        rows = rows.where(F.col("sent") < F.col("n_breaks"))
    fields = _fields(F.col("line"))
    return rows.select(
        "file",
        "sent",
        "pos",
        fields.getItem(0).alias("word"),
        fields.getItem(1).alias("pos_tag"),
        fields.getItem(2).alias("chunk_tag"),
        fields.getItem(3).alias("tag"),
    )


def sentence_count(numbered: DataFrame) -> DataFrame:
    """Number of closed sentences per corpus (one row)."""
    return numbered.agg(F.sum(F.col("is_break").cast("bigint")).alias("n_sentences"))


def read_corpus(spark: SparkSession, path: str | list[str], strict_reference: bool = False) -> DataFrame:
    """Read a column-format corpus as token rows."""
    return sentence_tokens(number_sentences(scan_lines(spark, path)), strict_reference)


def file_numbers(tokens: DataFrame) -> DataFrame:
    """Add ``file_no``, the rank of the file by name, so that order keys are numeric (one row per file)."""
    files = tokens.select("file").distinct()
    ranked = files.withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)
    return tokens.join(ranked, "file")
