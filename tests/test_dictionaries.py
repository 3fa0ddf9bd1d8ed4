import pytest
from pyspark.sql import functions as F

from structweave.operators import dictionaries as D
from structweave.operators import segments as S
from structweave.plans import queries as Q
from structweave.plans import surrogates as V


@pytest.fixture(scope="module")
def tokens(spark):
    words = "the a the START <unk> the rare a START STOP the the".split()
    rows = [(i // 4, 0, i % 4, w, f"P{i % 3}", "B" if i % 4 == 0 else "I", "O") for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "doc int, line int, pos int, word string, pos_tag string, chunk_tag string, tag string")


def order():
    return D.order_key(F.col("doc"), F.col("line"), F.col("pos"))


def test_order_key_sorts_like_the_triple(spark):
    big = 10**9 - 1
    rows = [(a, b, c) for a in (-5, 0, 7, 2**62) for b in (0, 3, big) for c in (0, 9, big)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    found = df.orderBy(D.order_key(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [tuple(r) for r in found] == sorted(rows)


def test_vocabulary_is_in_first_appearance_order(tokens):
    vocab = D.vocabulary(tokens, order(), threshold=1)
    assert {r.word: (r.id, r.n) for r in vocab.collect()} == {"the": (1, 5), "a": (2, 2), "START": (3, 2)}
    reserved = {r.word: r.id for r in D.with_reserved_words(vocab).where("reserved").collect()}
    assert reserved == {"<unk>": 0, "START": -1, "STOP": -2}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_encoding_is_the_same_with_and_without_broadcast(tokens, monkeypatch, limit):
    vocab = D.vocabulary(tokens, order(), threshold=1)
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(D, "HOT_WORDS", 2)
    encoded = D.encode_words(tokens, vocab, F.col("pos")).orderBy("doc", "pos")
    assert [r.word_id for r in encoded.collect()] == [1, 2, 1, 3, 0, 1, 0, 2, 3, 0, 1, 1]


def test_unknown_tags_are_listed_and_fail_strict_encoding(spark, tokens):
    tags = D.tag_dictionary(tokens.where("pos_tag <> 'P2'"), order())
    assert [(r.kind, r.tag, r.n) for r in D.unknown_tags(tokens, tags).collect()] == [("pos", "P2", 4)]
    with pytest.raises(Exception, match="unknown pos tag: P2"):
        D.encode_tags(tokens, tags).collect()
    known = D.encode_tags(tokens, D.tag_dictionary(tokens, order())).orderBy("doc", "pos").collect()
    assert [r.pos_id for r in known][:4] == [0, 1, 2, 0]


def test_segments_repeat_neighbours_and_give_tokens_back(spark):
    rows = [("s", i, 11, i * 10, i, i + 1, i % 2) for i in range(11)] + [("t", 0, 1, 5, 5, 5, 1)]
    df = spark.createDataFrame(rows, "k string, pos long, len long, word long, pos_tag long, chunk long, tag long")
    segs = S.segments(df, ["k"], 4)
    found = {(r.k, r.seg): r for r in segs.collect()}
    assert found[("s", 1)].words == [20, 30, 40, 50, 60, 70, 80, 90] and found[("s", 1)].left == 2
    assert found[("s", 2)].n == 3 and found[("t", 0)].left == 0
    back = S.own_tokens(segs, ["k"], 4).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    whole, cut = (sorted(map(tuple, S.context_window(df, ["k"], n).collect()), key=str) for n in (4096, 4))
    assert whole == cut


def test_words_that_are_frequent_but_unknown_are_hot_too(spark, tokens, monkeypatch):
    vocab = D.vocabulary(tokens.where("word <> 'the'"), order(), threshold=1)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "HOT_WORDS", 3)
    with_null = tokens.unionByName(tokens.limit(1).withColumn("word", F.lit(None).cast("string")))
    encoded = D.encode_words(with_null, vocab, F.col("pos"))
    assert encoded.where("word = 'the' and word_id <> 0").count() == 0 and encoded.where("word is null and word_id = 0").count() == 1
    assert encoded.count() == with_null.count() and {r.word_id for r in encoded.where("word = 'a'").collect()} == {1}


def test_null_keys_are_ranked_and_split(spark):
    from structweave.operators.ranking import hash_rank, hash_split

    df = spark.createDataFrame([(None,), *((i,) for i in range(9))], "k long")
    assert sorted(r["rank"] for r in hash_rank(df, "k", 1).collect()) == list(range(10))
    assert hash_split(df, "k").count() == 10


def test_tokens_of_frequent_words_are_not_shuffled(spark, monkeypatch):
    rows = [(i, "often" if i % 10 else f"rare{i}") for i in range(400)]
    tokens = spark.createDataFrame(rows, "pos long, word string").repartition(4, "pos")
    vocab = spark.createDataFrame([("often", 1, 360), *((f"rare{i}", i + 2, 1) for i in range(0, 200, 10))], "word string, id long, n long")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(D, "HOT_WORDS", 1)
    encoded = D.encode_words(tokens, vocab, F.col("pos"))
    place = tokens.select("pos", F.spark_partition_id().alias("before"))
    moved = encoded.withColumn("after", F.spark_partition_id()).join(place, "pos").where("word = 'often' and before <> after")
    assert moved.count() == 0
    found = {r.pos: r.word_id for r in encoded.collect()}
    assert found == {i: 1 if i % 10 else (i + 2 if i < 200 else 0) for i in range(400)}


def test_segments_of_tokens_that_stand_together_are_the_same(spark):
    rows = [("s", i, 11, i * 10, i, i + 1, i % 2) for i in range(11)] + [(None, i, 3, 5 - i, 5, 5, None) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, pos long, len long, word long, pos_tag long, chunk long, tag long")
    for source in (df.coalesce(1), df.repartition(4, "pos"), df.orderBy(F.col("pos").desc())):
        plain, put = (sorted(map(tuple, S.segments(source, ["k"], 4, t).collect()), key=str) for t in (False, True))
        assert plain == put and len(put) == 4
    tokens = df.where("k = 's'").unionByName(df.where("k = 's'"))  # equal rows stay as often as they come
    assert sorted(map(tuple, S.segments(tokens, ["k"], 11, True).collect())) == sorted(map(tuple, S.segments(tokens, ["k"], 11).collect()))


def test_frequent_words_that_a_shared_dictionary_lacks_are_not_shuffled(spark, monkeypatch):
    rows = [(i, "train" if i < 100 else "dev", "known" if i < 100 else "unseen" if i % 10 else f"rare{i}") for i in range(400)]
    tokens = spark.createDataFrame(rows, "pos long, split string, word string").repartition(4, "pos")
    vocab = D.vocabulary(tokens.where("split = 'train'"), F.col("pos").cast("decimal(38,0)"), threshold=2)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "HOT_WORDS", 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would broadcast so small a dictionary by itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        encoded = D.encode_words(tokens, vocab, F.col("pos"))
        placed = encoded.withColumn("after", F.spark_partition_id()).select("pos", "word", "after").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = {r.pos: r.before for r in tokens.select("pos", F.spark_partition_id().alias("before")).collect()}
    often = [r for r in placed if r.word in ("known", "unseen")]
    # The branches of the lookup follow each other, so a place is told by its number within the first.
    assert len(often) == 370 and all(r.after == before[r.pos] for r in often)
    found = {(r.split, r.word_id): r["count"] for r in encoded.groupBy("split", "word_id").count().collect()}
    assert found == {("train", 1): 100, ("dev", 0): 300}


@pytest.fixture
def plain_joins(spark):
    """Only what asks for a broadcast is broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rare_words_that_the_vocabulary_lacks_are_not_shuffled(spark, monkeypatch, plain_joins):
    rows = [(i, f"known{i // 4}" if i < 200 else None if i == 200 else f"unseen{i}") for i in range(600)]
    tokens = spark.createDataFrame(rows, "pos long, word string").repartition(4, "pos")
    vocab = spark.createDataFrame([(f"known{i}", i + 1, 4) for i in range(50)], "word string, id long, n long")
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "HOT_WORDS", 1)
    placed = D.encode_words(tokens, vocab, F.col("pos")).withColumn("after", F.spark_partition_id()).collect()
    before = {r.pos: r.before for r in tokens.select("pos", F.spark_partition_id().alias("before")).collect()}
    # The bits are a fixed hash: none of these words falls on a bit of the vocabulary's.
    assert all(r.after == before[r.pos] for r in placed if r.pos >= 200)
    assert {r.pos: r.word_id for r in placed} == {i: i // 4 + 1 if i < 200 else 0 for i in range(600)}


@pytest.mark.parametrize("rows_of_marks", [1, 2])
def test_words_that_share_a_bit_with_the_vocabulary_are_told_apart(spark, monkeypatch, rows_of_marks):
    words = [f"w{i}" for i in range(400)]
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos long, word string")
    vocab = spark.createDataFrame([(w, i + 1, 1) for i, w in enumerate(words) if i % 2], "word string, id long, n long")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "HOT_WORDS", 10)
    monkeypatch.setattr(D, "MARK_ROWS", rows_of_marks)
    found = {r.pos: r.word_id for r in D.encode_words(tokens, vocab, F.col("pos")).collect()}
    assert found == {i: i + 1 if i % 2 else 0 for i in range(400)}


@pytest.fixture
def labelled_texts(spark, tmp_path):
    texts = [(i, f"the word w{i}\nthe end. {i}") for i in range(20)] + [(None, "the lost"), (3, "the third"), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i in range(0, 20, 3)] + [(3, 1), (None, 1), (99, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_texts_are_not_shuffled_to_tell_their_split(spark, plain_joins, labelled_texts):
    plan = Q.shared_dictionary_load(spark, labelled_texts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "BroadcastHashJoin [doc_id" in plan


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_splits_are_the_same_whether_labels_are_broadcast_or_not(spark, monkeypatch, labelled_texts, limit):
    monkeypatch.setattr(V, "LABEL_ROWS", limit)
    found = V.line_tokens(spark, labelled_texts, V.split_documents(spark, labelled_texts))
    plain = V.line_tokens(spark, labelled_texts)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    counted = {r.split: (r.n_tokens, r.n_unknown) for r in Q.shared_dictionary_load(spark, labelled_texts).collect()}
    # In the labelled texts "the" comes 15 times, "word" and "end." 7 times, every other word less than three times.
    assert counted == {"train": (7 * 6 + 2, 7 * 2 + 1), "dev": (13 * 6 + 2, 13 * 2 + 1)}
