import random

from pyspark.sql import functions as F

from structweave.operators import ranking


def test_number_within_with_a_hot_group(spark):
    rng = random.Random(1)
    groups = [None, *range(1, 50)]
    rows = [(0 if rng.random() < 0.5 else rng.choice(groups), rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, t int, id int")
    found = ranking.number_within(df, ["g"], ["t", "id"], F.floor(F.col("t") / 100)).collect()
    groups = {}
    for g, t, i in rows:
        groups.setdefault(g, []).append((t, i))
    expected = {(g, i): (p, len(v)) for g, v in groups.items() for p, (_, i) in enumerate(sorted(v))}
    assert {(r.g, r.id): (r.pos, r.len) for r in found} == expected


def test_global_index_and_running_sums(spark):
    values = random.Random(2).sample(range(10**6), 2000)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v int, x int")
    index = {r.v: r.id for r in ranking.global_index(df, [F.col("v")]).collect()}
    assert index == {v: i for i, v in enumerate(sorted(values))}
    sums = {r.v: r.s for r in ranking.running_sums(df, [F.col("v").desc()], {"s": "x"}).collect()}
    total = 0
    for v in sorted(values, reverse=True):
        total += v % 7
        assert sums[v] == total


def test_hash_split_is_exact_and_agrees_with_the_rank(spark):
    for n in (1, 2, 3, 7, 1001):
        df = spark.range(n).withColumnRenamed("id", "k")
        ranks = {r.k: r.rank for r in ranking.hash_rank(df, "k", 3).collect()}
        assert sorted(ranks.values()) == list(range(n))
        split = {r.k: r.split for r in ranking.hash_split(df, "k", 3).collect()}
        assert split == {k: "train" if r < 3 * n // 4 else "val" for k, r in ranks.items()}


def test_cut_equals_split(spark):
    ids = spark.createDataFrame([(None,), *((i * 37 - 5000,) for i in range(1_001))], "id long")
    split = {r.id: r.split for r in ranking.hash_split(ids, "id", 4).collect()}
    cut = ranking.hash_cut(ids.repartition(5), "id", 4)
    twice = ids.unionAll(ids).withColumn("first", ranking.before_cut(F.col("id"), 4, cut))
    found = twice.collect()
    assert len(found) == 2_004 and all(r.first == (split[r.id] == "train") for r in found)
    assert sum(r.first for r in found) == 2 * (1_002 * 3 // 4)
    assert ranking.hash_cut(ids.limit(0), "id", 4) is None
    one = ids.where("id = 32")
    assert not one.select(ranking.before_cut(F.col("id"), 4, ranking.hash_cut(one, "id", 4))).first()[0]
