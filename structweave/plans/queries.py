"""The registered queries: each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round9
from ..operators import binary, candidates, dictionaries, features, metrics, ranking, segments, sequences
from ..session import scratch_path
from ..sources import corpus, tables
from . import experiments, surrogates as s
from .frank_wolfe import fit_frank_wolfe
from .loaders import split_packed
from .losses import CandidateLoss, LogisticKernel, LogisticLoss, SequenceLoss, TableLoss
from .schedules import L2Penalty, Penalty
from .solvers import Run
from .train import BATCH, LOCAL, MINIBATCH, fit, gradient_norm_below, train_log as log_table

Query = Callable[[SparkSession, str], DataFrame]

MU = 0.5
TOP = 5
SEQUENCE_MU = 2.0
SEQUENCE_TOP = 3
SMOOTH_PASSES = 50
TOP_CELLS = 3
SPLIT_SEED = 1
MARKER_LINES = "Licensed "  # document lines that become document markers in the corpus round trip


def _line_order() -> F.Column:
    return dictionaries.order_key(F.col("doc_id"), F.col("line_no"), F.col("pos"))


# Corpus ---------------------------------------------------------------------------------------------


def _column_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in column format, one text value per document."""
    marker = F.lit("-DOCSTART- -X- O O")

    def token_line(word):
        return F.concat(word, F.lit(" P C "), F.when(word.endswith("."), "END").otherwise("O"), F.lit("\n"))

    def block(line):
        return F.array_join(F.transform(F.filter(F.split(line, " "), lambda x: x != ""), token_line), "")

    lines = F.transform(
        F.split("text", "\n"), lambda line: F.when(line.startswith(MARKER_LINES), marker).otherwise(block(line))
    )
    closing = F.when(F.element_at(lines, -1) == marker, F.lit("\n")).otherwise(F.lit(""))
    return s.documents(spark, sf_dir).select(F.concat(F.array_join(lines, "\n"), closing).alias("value"))


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    _column_format(spark, sf_dir).write.text(path)
    return corpus.number_sentences(corpus.scan_lines(spark, path))


def corpus_scan(spark, sf_dir):
    """Write the documents as a column-format corpus, scan it back, segment it into sentences."""
    tokens = corpus.sentence_tokens(_round_trip(spark, sf_dir))
    return tokens.groupBy("pos", "word", "pos_tag", "chunk_tag", "tag").agg(F.count(F.lit(1)).alias("n"))


def sentence_count(spark, sf_dir):
    """S3."""
    return corpus.sentence_count(_round_trip(spark, sf_dir))


def sentence_lengths(spark, sf_dir):
    """The sentences themselves, as how many there are of each number of tokens."""
    tokens = corpus.sentence_tokens(_round_trip(spark, sf_dir))
    sizes = tokens.groupBy("file", "sent").agg(F.count(F.lit(1)).alias("n_tokens"))
    return sizes.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_sentences"))


def word_count(spark, sf_dir):
    """P1."""
    return dictionaries.word_counts(s.line_tokens(spark, sf_dir))


def vocabulary(spark, sf_dir):
    """Words seen more than twice, ids by first appearance, reserved rows."""
    vocab = dictionaries.vocabulary(s.line_tokens(spark, sf_dir), _line_order(), threshold=2)
    return dictionaries.with_reserved_words(vocab)


def tag_dictionary(spark, sf_dir):
    """Ids per tag kind by first appearance, reserved rows; read by id it is the inverse."""
    return dictionaries.with_reserved_tags(dictionaries.tag_dictionary(s.line_tokens(spark, sf_dir), _line_order()))


def encode_words(spark, sf_dir):
    """P6."""
    tokens = s.line_tokens(spark, sf_dir)
    vocab = dictionaries.vocabulary(tokens, _line_order(), threshold=2)
    encoded = dictionaries.encode_words(tokens, vocab, F.col("pos"))
    return encoded.select("doc_id", "line_no", "pos", "word_id")


def inverse_words(spark, sf_dir):
    """P5: back from ids to words; what the vocabulary lacks comes back as the unknown word."""
    tokens = s.line_tokens(spark, sf_dir)
    vocab = dictionaries.vocabulary(tokens, _line_order(), threshold=2)
    encoded = dictionaries.encode_words(tokens, vocab, F.col("pos"))
    counts = encoded.groupBy(F.col("word_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tokens"))
    return dictionaries.inverse(counts, dictionaries.with_reserved_words(vocab), "word").select("word", "n_tokens")


def _affix_tokens(spark, sf_dir):
    """Tokens whose POS and chunk tags are word endings and beginnings, so that unseen tags occur."""
    tokens = s.line_tokens(spark, sf_dir, s.split_documents(spark, sf_dir))
    return tokens.withColumn("pos_tag", F.expr("right(word, 2)")).withColumn("chunk_tag", F.expr("left(word, 1)"))


def unknown_tags(spark, sf_dir):
    """Tags of all documents that the dictionary of the labelled ones lacks."""
    tokens = _affix_tokens(spark, sf_dir)
    train = tokens.where(F.col("split") == "train")
    return dictionaries.unknown_tags(tokens, dictionaries.tag_dictionary(train, _line_order()))


def _encoded_lines(spark, sf_dir):
    tokens = s.line_tokens(spark, sf_dir)
    vocab = dictionaries.vocabulary(tokens, _line_order(), threshold=2)
    tags = dictionaries.tag_dictionary(tokens, _line_order())
    words = dictionaries.encode_words(tokens, vocab, F.col("pos"), "word_id")
    encoded = dictionaries.encode_tags(words, tags)
    return encoded.select(
        *s.LINE_KEYS,
        "pos",
        "len",
        F.col("word_id").alias("word"),
        F.col("pos_id").alias("pos_tag"),
        F.col("chunk_id").alias("chunk"),
        F.col("tag_id").alias("tag"),
    )


def encoded_sequences(spark, sf_dir):
    """Strictly encoded lines, assembled in order."""
    table = segments.segments(_encoded_lines(spark, sf_dir), s.LINE_KEYS, together=True)
    joined = [
        F.array_join(F.transform(F.slice(c, F.col("left") + 1, F.col("n")), lambda x: x.cast("string")), ",").alias(c)
        for c in ("words", "pos_tags", "chunks", "tags")
    ]
    return table.select(*s.LINE_KEYS, "seg", "len", *joined)


def shared_dictionary_load(spark, sf_dir):
    """Dictionaries of the labelled documents encode both these and the rest; coverage per split."""
    tokens = s.line_tokens(spark, sf_dir, s.split_documents(spark, sf_dir))
    vocab = dictionaries.vocabulary(tokens.where(F.col("split") == "train"), _line_order(), threshold=2)
    encoded = dictionaries.encode_words(tokens, vocab, F.col("pos"))
    return encoded.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum((F.col("word_id") == 0).cast("bigint")).alias("n_unknown"),
        F.sum("word_id").alias("id_sum"),
    )


def split_train_val(spark, sf_dir):
    """P12 over orders."""
    orders = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"))
    return ranking.hash_split(orders, "group_id", SPLIT_SEED)


def shuffled_rank(spark, sf_dir):
    """The exact shuffled order itself."""
    orders = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"))
    return ranking.hash_rank(orders, "group_id", SPLIT_SEED)


# Candidates -----------------------------------------------------------------------------------------


def _flat(df, *extra):
    return df.select(
        "group_id", *[F.col(f"cand.{f}").alias(f) for f in ("linenumber", "partkey", "suppkey")], *extra
    )


def candidate_scores(spark, sf_dir):
    """I1, I2."""
    scored = candidates.score(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    price = F.col("cand.price").alias("price")
    return _flat(scored, price, round9(F.col("score")).alias("score"), round9(F.col("aug")).alias("aug"))


def candidate_truncate(spark, sf_dir):
    """The first three candidates per group here; the loader's default is 1000."""
    return _flat(candidates.truncate(s.candidates(spark, sf_dir), 3), F.col("cand_id").cast("bigint").alias("cand_id"))


def candidate_gold(spark, sf_dir):
    """P10."""
    return _flat(candidates.gold(s.candidates(spark, sf_dir)), round9(F.col("iou")).alias("iou"))


def candidate_relevance(spark, sf_dir):
    """Relevant candidates per group."""
    labelled = candidates.relevant(s.candidates(spark, sf_dir))
    return labelled.groupBy("group_id").agg(
        F.sum(F.col("relevant").cast("bigint")).alias("n_relevant"), F.count(F.lit(1)).alias("n")
    )


def candidate_argmax(spark, sf_dir):
    """I4 on augmented scores."""
    best = candidates.argmax(candidates.score(s.candidates(spark, sf_dir), s.CANDIDATE_W), "aug", ("cand", "aug"))
    return _flat(best, round9(F.col("aug")).alias("aug"))


def candidate_topk(spark, sf_dir):
    """I5, I8."""
    scored = candidates.score(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    best = candidates.top_k(scored.select("group_id", "cand", "aug"), TOP)
    return _flat(best, F.col("rank").cast("bigint").alias("rank"), round9(F.col("aug")).alias("aug"))


def simplex_weights(spark, sf_dir):
    """I9."""
    scored = candidates.score(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    weighted = candidates.simplex_weights(candidates.top_k(scored.select("group_id", "cand", "aug"), TOP), MU)
    return weighted.select("group_id", F.col("rank").cast("bigint").alias("rank"), round9(F.col("weight")).alias("weight"))


def candidate_hinge(spark, sf_dir):
    """L4."""
    return candidates.hinge(s.candidates(spark, sf_dir), s.CANDIDATE_W).select(
        "group_id", round9(F.col("hinge")).alias("hinge")
    )


def candidate_smoothed_hinge(spark, sf_dir):
    """L5."""
    values = candidates.smoothed_hinge(s.candidates(spark, sf_dir), s.CANDIDATE_W, MU, TOP)
    return values.select("group_id", round9(F.col("hinge")).alias("hinge"), round9(F.col("smooth")).alias("smooth"))


def candidate_batch_loss(spark, sf_dir):
    """L14 of L4 and L5."""
    values = candidates.smoothed_hinge(s.candidates(spark, sf_dir), s.CANDIDATE_W, MU, TOP)
    return values.agg(
        round9(F.avg("hinge")).alias("hinge"), round9(F.avg("smooth")).alias("smooth"), F.count(F.lit(1)).alias("n")
    )


def _mean(gradient, n):
    return gradient.select("idx", round9(F.col("value") / F.lit(float(n))).alias("value"))


def _group_count(df):
    return df.select("group_id").distinct().count()


def candidate_subgradient(spark, sf_dir):
    """L6, L14."""
    df = s.candidates(spark, sf_dir)
    return _mean(candidates.subgradient_sum(df, s.CANDIDATE_W), _group_count(df))


def candidate_smoothed_gradient(spark, sf_dir):
    """L7, L14."""
    df = s.candidates(spark, sf_dir)
    return _mean(candidates.smoothed_gradient_sum(df, s.CANDIDATE_W, MU, TOP), _group_count(df))


def candidate_lmo(spark, sf_dir):
    """L12."""
    minima = candidates.linear_minimizers(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    parts = [round9(F.col("psi").getItem(j)).alias(f"psi{j}") for j in range(4)]
    return minima.select("group_id", *parts, round9(F.col("loss")).alias("loss"))


def candidate_predict(spark, sf_dir):
    """I11."""
    best = candidates.predict(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    return _flat(best, round9(F.col("score")).alias("score"), round9(F.col("iou")).alias("iou"))


def candidate_mean_iou(spark, sf_dir):
    """E3."""
    best = candidates.predict(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    return candidates.mean_iou(best).select(round9(F.col("mean_iou")).alias("mean_iou"))


def candidate_accuracy(spark, sf_dir):
    """E4."""
    best = candidates.predict(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    return candidates.accuracy(best).select(round9(F.col("accuracy")).alias("accuracy"))


def candidate_micro_ap(spark, sf_dir):
    """E5, groups padded to 1000 cells."""
    scored = candidates.score(s.candidates(spark, sf_dir), s.CANDIDATE_W)
    exact = scored.withColumn("score", round9(F.col("score")))
    return candidates.micro_average_precision(exact).select(
        round9(F.col("average_precision")).alias("average_precision")
    )


# Binary ---------------------------------------------------------------------------------------------


def dense_examples(spark, sf_dir):
    """Dense rows with a derived 0/1 target."""
    df = s.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    derived = binary.with_target(df, "label", 3)
    total = F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return derived.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), round9(total).alias("total"), "y")


def logistic_rows(spark, sf_dir):
    """L1, L2 per row."""
    df = binary.losses(s.examples(spark, sf_dir), s.EXAMPLE_W)
    both = binary.residuals(df.select("id", "feats", "y", "loss"), s.EXAMPLE_W)
    return both.select("id", round9(F.col("loss")).alias("loss"), round9(F.col("residual")).alias("residual"))


def logistic_loss(spark, sf_dir):
    """L1 mean."""
    df = binary.losses(s.examples(spark, sf_dir), s.EXAMPLE_W)
    return df.agg(round9(F.avg("loss")).alias("loss"), F.count(F.lit(1)).alias("n"))


def logistic_gradient(spark, sf_dir):
    """L3 mean."""
    df = s.examples(spark, sf_dir)
    return _mean(binary.gradient_sum(df, s.EXAMPLE_W), df.count())


def logistic_error(spark, sf_dir):
    """E1."""
    return binary.error(s.examples(spark, sf_dir), s.EXAMPLE_W).select(round9(F.col("error")).alias("error"))


def _mean_vector(df):
    exploded = df.select(F.posexplode("feats").alias("idx", "x"))
    return exploded.groupBy("idx").agg(F.avg("x").alias("w"))


def l2_penalty(spark, sf_dir):
    """Distance of the mean of class 1 from the overall mean."""
    df = s.examples(spark, sf_dir)
    penalty = binary.l2_penalty(_mean_vector(df.where(F.col("y") == 1)), 0.1, _mean_vector(df))
    return penalty.select(round9(F.col("penalty")).alias("penalty"))


def objective(spark, sf_dir):
    """Mean logistic loss plus the penalty of the class mean taken as the model."""
    df = s.examples(spark, sf_dir)
    loss = binary.losses(df, s.EXAMPLE_W).agg(F.avg("loss").alias("part"))
    penalty = binary.l2_penalty(_mean_vector(df.where(F.col("y") == 1)), 0.1).select(F.col("penalty").alias("part"))
    return loss.unionAll(penalty).agg(round9(F.sum("part")).alias("objective"))


def gradient_norm(spark, sf_dir):
    """Norm of the mean loss gradient, penalty excluded."""
    df = s.examples(spark, sf_dir)
    n = df.count()
    mean = binary.gradient_sum(df, s.EXAMPLE_W).select("idx", (F.col("value") / F.lit(float(n))).alias("value"))
    return binary.gradient_norm(mean).select(round9(F.col("norm")).alias("norm"))


# Sequences ------------------------------------------------------------------------------------------


def _event_table(spark, sf_dir):
    return sequences.SequenceTable.from_tokens(s.event_tokens(spark, sf_dir), s.SEQUENCE_KEYS, s.SEQUENCE_TAGS)


def _day(df, *columns):
    return df.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), *columns)


def context_window(spark, sf_dir):
    """F1."""
    framed = segments.context_window(s.event_tokens(spark, sf_dir), s.SEQUENCE_KEYS)
    names = ("w", "w_m1", "w_n1", "p", "p_m1", "p_n1", "c", "c_m1", "c_n1", "y", "y1")
    second = [F.coalesce(c, F.lit(-99)).alias(c) for c in ("w_m2", "w_n2")]
    return _day(framed, "pos", *names, *second)


def hashed_features(spark, sf_dir):
    """F2, F3."""
    hashed = features.hashed_features(s.event_tokens(spark, sf_dir), s.SEQUENCE_KEYS, s.SEQUENCE_DIM)
    text = F.array_join(F.transform("idx", lambda x: x.cast("string")), ",")
    return _day(hashed, "pos", text.alias("idx"))


def sequence_feature_counts(spark, sf_dir):
    """F4."""
    return _day(sequences.feature_counts(_event_table(spark, sf_dir), s.SEQUENCE_DIM), "idx", "n")


def edge_scores(spark, sf_dir):
    """Loss-augmented edge scores."""
    edges = sequences.edge_scores(_event_table(spark, sf_dir), s.SEQUENCE_W, use_loss=True)
    return _day(edges, "pos", "y1", "y", F.col("score").alias("score"))


def largest_edges(spark, sf_dir):
    """I8: the three largest cells of the (previous tag, tag) table at each position, with their indices."""
    edges = sequences.edge_scores(_event_table(spark, sf_dir), s.SEQUENCE_W)
    best = sequences.k_largest(edges, (*s.SEQUENCE_KEYS, "pos"), TOP_CELLS)
    return _day(best, "pos", F.col("rank").cast("bigint").alias("rank"), "y1", "y", "score")


def sequence_score(spark, sf_dir):
    """F6."""
    return _day(sequences.sequence_score(_event_table(spark, sf_dir), s.SEQUENCE_W), "score")


def _path(column="path"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "").alias("path")


def viterbi_path(spark, sf_dir):
    """Loss-augmented best tagging."""
    best = sequences.decode(_event_table(spark, sf_dir), s.SEQUENCE_W, use_loss=True)
    return _day(best, "score", _path())


def viterbi_topk(spark, sf_dir):
    """I7, I8."""
    best = sequences.decode(_event_table(spark, sf_dir), s.SEQUENCE_W, SEQUENCE_TOP, use_loss=True)
    return _day(best, F.col("rank").cast("bigint").alias("rank"), "score", _path())


def predict_tags(spark, sf_dir):
    """I10."""
    return _day(sequences.predict_tags(_event_table(spark, sf_dir), s.SEQUENCE_W), "pos", "tag", "predicted")


def hamming(spark, sf_dir):
    """E6."""
    predicted = sequences.predict_tags(_event_table(spark, sf_dir), s.SEQUENCE_W)
    return _day(sequences.hamming(predicted, s.SEQUENCE_KEYS), "distance")


def weighted_f1(spark, sf_dir):
    """E2, tag 0 playing the outside tag."""
    predicted = sequences.predict_tags(_event_table(spark, sf_dir), s.SEQUENCE_W)
    return metrics.weighted_f1(predicted, 0).select(round9(F.col("weighted_f1")).alias("weighted_f1"))


def sequence_hinge(spark, sf_dir):
    """L8."""
    return _day(sequences.sequence_values(_event_table(spark, sf_dir), s.SEQUENCE_W), round9(F.col("hinge")).alias("hinge"))


def sequence_smoothed_hinge(spark, sf_dir):
    """L9."""
    values = sequences.sequence_values(_event_table(spark, sf_dir), s.SEQUENCE_W, SEQUENCE_MU, SEQUENCE_TOP)
    return _day(values, round9(F.col("hinge")).alias("hinge"), round9(F.col("smooth")).alias("smooth"))


def _mean_sparse(gradient, table):
    n = table.df.where(F.col("seg") == 0).count()
    return _mean(gradient, n).where(F.col("value") != 0)


def sequence_subgradient(spark, sf_dir):
    """L10, L14."""
    table = _event_table(spark, sf_dir)
    return _mean_sparse(sequences.gradient_sum(table, s.SEQUENCE_W), table)


def sequence_smoothed_gradient(spark, sf_dir):
    """L11, L14."""
    table = _event_table(spark, sf_dir)
    return _mean_sparse(sequences.gradient_sum(table, s.SEQUENCE_W, SEQUENCE_MU, SEQUENCE_TOP), table)


def sequence_lmo(spark, sf_dir):
    """L13."""
    minima = sequences.linear_minimizers(_event_table(spark, sf_dir), s.SEQUENCE_W)
    pairs = F.transform(
        F.arrays_zip("idx", "val"), lambda p: F.concat_ws(":", p.idx.cast("string"), F.round(p.val).cast("bigint").cast("string"))
    )
    return _day(minima, F.array_join(pairs, ",").alias("psi"), F.col("loss").cast("bigint").alias("loss"))


# Training -------------------------------------------------------------------------------------------

STEP_PENALTY = 0.01
BLOCK_PENALTY = 0.1


def _weights(spark, result):
    return result.weights(spark).select("idx", round9(F.col("w")).alias("w"))


def sample_draws(spark, sf_dir):
    """Draws with replacement, one per row, counted per row."""
    rows = ranking.hash_rank(s.small_examples(spark, sf_dir).select("id"), "id", SPLIT_SEED, "row", "size")
    return ranking.draw_counts(rows, "row", "size", 5).select("id", "n_draws")


def _small_steps(spark, sf_dir, algorithm, passes, n_buckets, **options):
    loss = LogisticLoss(s.small_examples(spark, sf_dir), 4)
    run = Run(algorithm, [L2Penalty(STEP_PENALTY)], options)
    mode = MINIBATCH if n_buckets > 1 else BATCH
    result = fit(loss, run, num_passes=passes, mode=mode, n_buckets=n_buckets, logging=False)
    loss.release()
    return _weights(spark, result)


def sgd_steps(spark, sf_dir):
    """Two passes of four minibatches, decaying rate, weighted average."""
    return _small_steps(
        spark, sf_dir, "sgd", 2, 4,
        learning_rate_scheme="linear", initial_learning_rate=0.5, learning_rate_time_factor=10.0,
    )


def svrg_steps(spark, sf_dir):
    """T4: two passes of three minibatches."""
    return _small_steps(spark, sf_dir, "svrg", 2, 3, learning_rate=0.5)


def accelerated_svrg_steps(spark, sf_dir):
    """T5: three passes of two minibatches, growing proximal weight, extrapolated start."""
    return _small_steps(
        spark, sf_dir, "csvrg", 3, 2,
        lipschitz=1.0, initial_moreau=0.05, moreau_rule="linear", warm_start="extrapolation",
    )


def bcfw_steps(spark, sf_dir):
    """Two passes of two rounds over all candidate groups."""
    loss = CandidateLoss(s.candidates(spark, sf_dir), 4)
    result = fit_frank_wolfe(
        loss, Run("bcfw", [L2Penalty(BLOCK_PENALTY)]), num_passes=2, n_buckets=2, logging=False
    )
    loss.release()
    return _weights(spark, result)


def fit_logistic(spark, sf_dir):
    """Accelerated SVRG, inner epochs next to the rows."""
    loss = LogisticLoss(s.examples(spark, sf_dir), 64)
    run = Run("csvrg", [L2Penalty(1e-3)], {"lipschitz": 0.25, "warm_start": "extrapolation"})
    result = fit(loss, run, num_passes=5, mode=LOCAL, logging=False)
    loss.release()
    return _weights(spark, result)


def _split_candidates(spark, sf_dir):
    packed = candidates.pack(s.candidates(spark, sf_dir))
    cut = ranking.hash_cut(packed[0].where("chunk = 0"), "group_id", SPLIT_SEED)
    return split_packed(packed, cut, SPLIT_SEED, 4, TOP).values()


def fit_candidates(spark, sf_dir):
    """T4 with smoothing on three quarters of the groups; the log has dev objective and metrics."""
    train, dev = _split_candidates(spark, sf_dir)
    run = Run("svrg", [L2Penalty(1e-3)], {"learning_rate": 0.05, "smoothing_coefficient": MU}, run_id="svrg")
    result = fit(train, run, num_passes=1, mode=LOCAL, dev=dev)
    train.release()
    dev.release()
    return log_table(spark, [result]).drop("seconds")


def fit_sequences(spark, sf_dir):
    """T5 with a decaying smoothing coefficient on all tagged sequences."""
    loss = SequenceLoss(_event_table(spark, sf_dir), s.SEQUENCE_DIM, k=SEQUENCE_TOP)
    options = {"learning_rate": 0.02, "initial_moreau": 1e-3, "initial_smoothing": 2.0, "smoothing_rule": "expo"}
    result = fit(loss, Run("csvrg_lr", [L2Penalty(1e-3)], options), num_passes=SMOOTH_PASSES, mode=LOCAL, logging=False)
    loss.release()
    return _weights(spark, result)


def fit_sequence_blocks(spark, sf_dir):
    """T6 on all tagged sequences."""
    loss = SequenceLoss(_event_table(spark, sf_dir), s.SEQUENCE_DIM)
    result = fit_frank_wolfe(loss, Run("bcfw", [L2Penalty(1e-2)]), num_passes=1, n_buckets=4, logging=False)
    loss.release()
    return _weights(spark, result)


def model_sink(spark, sf_dir):
    """The model of ``svrg_steps`` and its log written through the sinks; the model read back for its run."""
    loss = LogisticLoss(s.small_examples(spark, sf_dir), 4)
    run = Run("svrg", [L2Penalty(STEP_PENALTY)], {"learning_rate": 0.5}, run_id="steps")
    result = fit(loss, run, num_passes=2, mode=MINIBATCH, n_buckets=3)
    loss.release()
    log, model = scratch_path(spark, "log"), scratch_path(spark, "model")
    tables.write_log(log_table(spark, [result]), log, "binary", "svrg")
    tables.write_weights(result.weights(spark), model, "binary", "svrg")
    epochs = spark.read.parquet(log).where((F.col("run_id") == "steps") & (F.col("split") == "train"))
    weights = spark.read.parquet(model).where((F.col("run_id") == "steps") & (F.col("algorithm") == "svrg"))
    both = weights.join(epochs.groupBy("run_id").agg(F.count("epoch").alias("n_logged")), "run_id")
    return both.select("idx", round9(F.col("w")).alias("w"), "n_logged")


class SquaredKernel(LogisticKernel):
    """A loss of one's own: half the squared error."""

    def values(self, examples, w, mu):
        error = examples[0] @ w - examples[1]
        return error**2 / 2, error**2 / 2

    def _residual(self, examples, w, mu):
        return examples[0] @ w - examples[1]


class Shrink(Penalty):
    """A penalty of one's own: 0.01 times the squared norm."""

    def value(self, w):
        return 0.01 * float(w @ w)

    def gradient(self, w):
        return 0.02 * w

    def strong_convexity(self):
        return 0.02


def own_loss_steps(spark, sf_dir):
    """A loss, a penalty and a stop rule of one's own; gradient steps until the weights sum up to 0.3."""
    loss = TableLoss(s.small_examples(spark, sf_dir), ("id",), SquaredKernel(4))
    run = Run("sgd", [Shrink()], {"initial_learning_rate": 0.1, "averaging": "none"})
    result = fit(loss, run, num_passes=20, mode=BATCH, stop=lambda w, _: w.sum() >= 0.3, logging=False)
    loss.release()
    return _weights(spark, result)


class AbsoluteKernel(LogisticKernel):
    """A smoothed loss of one's own: the absolute error, rounded off where it is within ``mu``."""

    def values(self, examples, w, mu):
        error = np.abs(examples[0] @ w - examples[1])
        if mu is None:
            return error, error
        return error, np.where(error <= mu, error**2 / (2 * mu), error - mu / 2)

    def _residual(self, examples, w, mu):
        error = examples[0] @ w - examples[1]
        return np.sign(error) if mu is None else np.clip(error / mu, -1, 1)


def own_smoothed_steps(spark, sf_dir):
    """A smoothed loss of one's own, its coefficient falling by the schedule; block steps are refused to it."""
    loss = TableLoss(s.small_examples(spark, sf_dir), ("id",), AbsoluteKernel(4))
    options = {"lipschitz": 1.0, "initial_moreau": 0.05, "initial_smoothing": 2.0, "smoothing_rule": "linear"}
    result = fit(loss, Run("csvrg", [Shrink()], options), num_passes=3, mode=BATCH, logging=False)
    try:
        fit_frank_wolfe(loss, Run("bcfw", [Shrink()]), num_passes=1)
        refused = False
    except TypeError:
        refused = True
    loss.release()
    return _weights(spark, result).withColumn("refused", F.lit(refused))


def train_log(spark, sf_dir):
    """Objective per epoch with a stop rule on the gradient norm."""
    loss = LogisticLoss(s.small_examples(spark, sf_dir), 4)
    run = Run("svrg", [L2Penalty(STEP_PENALTY)], {"learning_rate": 0.5}, run_id="svrg")
    result = fit(loss, run, num_passes=3, mode=MINIBATCH, n_buckets=4, stop=gradient_norm_below(1e-5))
    loss.release()
    return log_table(spark, [result]).select("epoch", "split", "metric", round9(F.col("value")).alias("value"))


# Runs -----------------------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    """One class per document source, with its number of documents, times the option grid."""
    classes = s.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    runs = experiments.grid(
        classes, {"algorithm": experiments.ALGORITHMS, "l2reg": (1.0, 0.1, 0.01), "seed": (0, 1, 2)}
    )
    accelerated = F.col("algorithm").isin("csvrg", "csvrg_lr", "svrg")
    return (
        runs.withColumn("lr", F.lit(0.02))
        .withColumn("lr_t", F.lit(150000.0))
        .withColumn("L", F.lit(32.0))
        .withColumn("smoother", F.when(accelerated, F.lit(2.0)))
        .withColumn("decay_smoother", F.when(F.col("algorithm") == "csvrg_lr", "expo").otherwise("const"))
        .withColumn("K", F.lit(5))
        .withColumn("warm_start", F.when(F.col("algorithm") == "csvrg_lr", 2).otherwise(3))
    )


def run_grid(spark, sf_dir):
    """The grid with the penalty each run trains with."""
    runs = _runs(spark, sf_dir)
    return runs.select(
        "source", "algorithm", "l2reg", F.col("seed").cast("bigint").alias("seed"), "n",
        F.round(F.col("l2reg") / F.col("n"), 12).alias("penalty"),
    )


def run_key(spark, sf_dir):
    """S9."""
    return experiments.run_key(_runs(spark, sf_dir)).select("source", "run_id")


def sweep(spark, sf_dir):
    """Every run of the run table that needs no blocks, over one persisted table; last objective per run."""
    key = ("source", "algorithm", "l2reg", "seed")
    runs = _runs(spark, sf_dir).where(F.col("algorithm") != "bcfw").withColumn("run_id", F.concat_ws("/", *[F.col(c).cast("string") for c in key]))
    loss = LogisticLoss(s.small_examples(spark, sf_dir), 4)
    logs = [log_table(spark, fits) for fits in experiments.sweep_table(loss, runs, num_passes=2, mode=MINIBATCH, n_buckets=4)]
    loss.release()
    last = reduce(DataFrame.unionAll, logs).groupBy("run_id").agg(round9(F.max_by("value", "epoch")).alias("objective"))
    return runs.join(last, "run_id").select("source", "algorithm", "l2reg", F.col("seed").cast("bigint").alias("seed"), "objective")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        corpus_scan, sentence_count, sentence_lengths, word_count, vocabulary, tag_dictionary, encode_words, inverse_words, unknown_tags,
        encoded_sequences, shared_dictionary_load, split_train_val, shuffled_rank,
        candidate_scores, candidate_truncate, candidate_gold, candidate_relevance, candidate_argmax,
        candidate_topk, simplex_weights, candidate_hinge, candidate_smoothed_hinge, candidate_batch_loss,
        candidate_subgradient, candidate_smoothed_gradient, candidate_lmo, candidate_predict,
        candidate_mean_iou, candidate_accuracy, candidate_micro_ap,
        dense_examples, logistic_rows, logistic_loss, logistic_gradient, logistic_error, l2_penalty,
        objective, gradient_norm,
        context_window, hashed_features, sequence_feature_counts, edge_scores, largest_edges, sequence_score,
        viterbi_path, viterbi_topk, predict_tags, hamming, weighted_f1,
        sequence_hinge, sequence_smoothed_hinge, sequence_subgradient, sequence_smoothed_gradient, sequence_lmo,
        sample_draws, sgd_steps, svrg_steps, accelerated_svrg_steps, bcfw_steps,
        fit_logistic, fit_candidates, fit_sequences, fit_sequence_blocks, train_log, model_sink, own_loss_steps, own_smoothed_steps, run_grid, run_key, sweep,
    )
}
