"""Views on the given tables that stand in for candidate groups, dense examples and tagged sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import number_within
from ..session import saved, spread

# Test weights of the registered queries.
CANDIDATE_W = (0.7, 0.3, -0.2, 0.1)
EXAMPLE_W = tuple((((7 * j) % 11) - 5) / 10.0 for j in range(64))
SMALL_W = (0.4, -0.3, 0.25, 0.2)
SEQUENCE_DIM = 997
SEQUENCE_W = np.array([((i * 37) % 101 - 50) / 64.0 for i in range(SEQUENCE_DIM)])
SEQUENCE_TAGS = 5
SEQUENCE_KEYS = ("user_id", "d")
LINE_KEYS = ("doc_id", "line_no")
# Ids of labelled documents that may be broadcast; they take some 60 bytes each.
LABEL_ROWS = 4_000_000
CAND_FIELDS = ("linenumber", "partkey", "suppkey", "ship", "price", "discount")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as candidates; ``cand`` is the struct that fixes their order."""
    order = F.struct(
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_shipdate").alias("ship"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
    )
    feats = F.array(
        F.col("l_extendedprice") / F.lit(1e5), F.col("l_discount") * F.lit(10.0), F.col("l_tax") * F.lit(10.0), F.lit(1.0)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        order.alias("cand"),
        (F.col("l_quantity") / F.lit(50.0)).alias("iou"),
        feats.alias("feats"),
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dense examples."""
    y = (F.col("label") < 5).cast("double")
    feats = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), feats.alias("feats"), y.alias("y"))


def small_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as examples with four features."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    feats = F.array(
        F.log(F.lit(1.0) + F.col("n_chars")) / F.lit(10.0),
        (F.col("lang") == "en").cast("double"),
        F.col("toxic").cast("double"),
        F.lit(1.0),
    )
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), feats.alias("feats"), F.col("quality").cast("double").alias("y")
    )


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as a tagged sequence, numbered without collecting a day in one task."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        F.to_date("ts").alias("d"),
        "ts",
        "event_id",
        F.floor(F.col("value") / F.lit(50.0)).cast("bigint").alias("word"),
        F.floor(F.hour("ts") / F.lit(6.0)).cast("bigint").alias("pos_tag"),
        F.pmod("event_id", F.lit(3)).cast("bigint").alias("chunk"),
        F.when(F.col("event_type") == "click", 0)
        .when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(4)
        .cast("bigint")
        .alias("tag"),
    )
    minute = F.hour("ts") * 60 + F.minute("ts")
    numbered = number_within(events, SEQUENCE_KEYS, ("ts", "event_id"), minute)
    return numbered.drop("ts", "event_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, spread over the cores when the file is small."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_labelled", F.lit(True))


def _mark_split(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    split = F.when(F.col("_labelled"), "train").otherwise("dev").alias("split")
    return texts.join(labelled, "doc_id", "left").select("doc_id", "text", split)


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their split, for queries that tell splits apart: (doc_id, text, split).

    The ids of labelled documents are broadcast once their number is checked, so texts stay where they are read. If there
    are more, texts are joined by shuffle and written, so that they move once however often they are read.
    """
    texts, labelled = documents(spark, sf_dir), _labelled(spark, sf_dir)
    if labelled.count() <= LABEL_ROWS:
        return _mark_split(texts, F.broadcast(labelled))
    return saved(_mark_split(texts, labelled), "split")


def document_lines(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None) -> DataFrame:
    """Every line of every document: (doc_id, split, line_no, line).

    ``split`` is train for labelled documents and dev for the rest, looked up before the text is taken apart, or that of
    ``marked`` documents.
    """
    if marked is None:
        marked = _mark_split(documents(spark, sf_dir), _labelled(spark, sf_dir))
    return marked.select("doc_id", "split", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_tokens(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None) -> DataFrame:
    """Every word of every document line (of ``marked`` documents, if given) as a tagged token; a line is a sequence."""
    words = F.filter(F.split("line", " "), lambda x: x != "")
    lines = document_lines(spark, sf_dir, marked).select("doc_id", "split", "line_no", words.alias("words"))
    size = F.size("words").cast("bigint").alias("len")
    tokens = lines.select("doc_id", "split", "line_no", size, F.posexplode("words").alias("pos", "word"))
    word, pos = F.col("word"), F.col("pos")
    pos_tag = (
        F.when(word.rlike("^[0-9]"), "NUM").when(word.rlike("^[A-Z]"), "CAP").when(word.rlike("^[a-z]"), "LOW")
    ).otherwise("OTH")
    chunk = F.when(pos == 0, "B").when(pos == F.col("len") - 1, "E").otherwise("I")
    tag = (
        F.when(word.contains("@"), "MAIL")
        .when(word.rlike("[0-9]"), "NUM")
        .when(word.endswith("."), "END")
        .when((pos > 0) & word.rlike("^[A-Z]"), "CAP")
        .otherwise("O")
    )
    return tokens.select(
        *LINE_KEYS,
        "split",
        pos.cast("bigint").alias("pos"),
        "len",
        "word",
        pos_tag.alias("pos_tag"),
        chunk.alias("chunk_tag"),
        tag.alias("tag"),
    )
