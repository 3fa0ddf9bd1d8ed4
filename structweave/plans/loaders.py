"""From files and tables to losses that are ready to train and evaluate on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join
from ..operators import candidates, dictionaries, ranking
from ..operators.segments import SEGMENT
from ..operators.sequences import SequenceTable
from ..session import materialize
from ..sources.corpus import file_numbers, read_corpus
from .losses import CandidateLoss, SequenceLoss


def encoded_sequences(tokens: DataFrame, vocab: DataFrame, tags: DataFrame) -> DataFrame:
    """Corpus tokens with ids and the length of their sentence; a tag that the dictionary lacks fails the job."""
    words = dictionaries.encode_words(tokens, vocab, F.col("pos"), "word_id")
    coded = dictionaries.encode_tags(words, tags)
    sizes = tokens.groupBy("file", "sent").agg(F.count("pos").alias("len"))
    return null_safe_join(coded, sizes, ["file", "sent"]).select(
        "file", "sent", "pos", "len", F.col("word_id").alias("word"), F.col("pos_id").alias("pos_tag"),
        F.col("chunk_id").alias("chunk"), F.col("tag_id").alias("tag"),
    )


def sequence_losses(
    spark: SparkSession, paths: Mapping[str, str | list[str]], dim: int, threshold: int = 2, k: int = 5,
    strict_reference: bool = False, size: int = SEGMENT,
) -> tuple[dict[str, SequenceLoss], DataFrame, DataFrame]:
    """Losses of the corpora in ``paths`` (``train`` and any others), the vocabulary and the tag dictionary.

    Both dictionaries come from ``train`` alone: words seen there more than ``threshold`` times, tags all of them.
    """
    read = {name: read_corpus(spark, path, strict_reference) for name, path in paths.items()}
    train = file_numbers(read["train"])
    order = dictionaries.order_key(F.col("file_no"), F.col("sent"), F.col("pos"))
    vocab = materialize(dictionaries.vocabulary(train, order, threshold))
    tags = materialize(dictionaries.tag_dictionary(train, order))
    n_tags = tags.where("kind = 'tag'").count()
    outside = tags.where("kind = 'tag' and tag = 'O'").select("id").first()
    losses = {}
    for name, tokens in read.items():
        table = SequenceTable.from_tokens(encoded_sequences(tokens, vocab, tags), ["file", "sent"], n_tags, size)
        losses[name] = SequenceLoss(table, dim, k, outside[0] if outside else 0)
    return losses, vocab, tags


def candidate_losses(labels: DataFrame, features: DataFrame, dim: int, k: int = 10, seed: int = 1, limit: int | None = None) -> dict[str, CandidateLoss]:
    """``train`` and ``val`` losses from label rows (group_id, cand, iou) and feature rows (group_id, cand, feats).

    Three quarters of the groups, by a hash of their id, are for training. Candidates without features are left out.
    """
    both = null_safe_join(labels, features, ["group_id", "cand"])
    packed = candidates.pack(both if limit is None else candidates.truncate(both, limit))
    cut = ranking.hash_cut(materialize(labels.select("group_id").distinct()), "group_id", seed)
    return split_packed(packed, cut, seed, dim, k, limit)


def split_packed(
    packed: tuple[DataFrame, bool], cut: tuple[int, int | None] | None, seed: int, dim: int, k: int = 10, limit: int | None = None
) -> dict[str, CandidateLoss]:
    """``train`` and ``val`` losses from groups packed once: the split is a filter on the packed rows."""
    rows, has_long = packed
    first = ranking.before_cut(F.col("group_id"), seed, cut)
    return {name: CandidateLoss.of_packed(rows.where(part), has_long, dim, k, limit) for name, part in (("train", first), ("val", ~first))}
