import re

import numpy as np
import xxhash

from structweave.llm.components import components
from structweave.llm.simhash import covering_masks, group, links_within_two, near_duplicate_stage, near_groups, op1_simhash

from .conftest import by_id, prose


def brute(texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for i in range(64):
                counts[i] += h >> i & 1
        return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))

    prints = {i: fingerprint(t) for i, t in texts}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_query_against_brute_force(spark, sf):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found == brute(texts)


def test_masks_cover_every_pair_of_bits():
    masks = covering_masks(64, 2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in masks)


def test_links_are_exactly_those_within_two_bits(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2**63, 30)]
    near = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 63, (8, 2))]
    far = [b ^ 0b111 for b in base]
    points = sorted({*base, *near, *far})
    df = spark.createDataFrame([(p,) for p in points], "f bigint")
    edges = {(e.a, e.b) for e in links_within_two(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    # Every pair within two bits is connected, through edges of the result.
    found = by_id(components(spark.createDataFrame(list(edges), "a bigint, b bigint")), "node")
    for k, a in enumerate(points):
        for b in points[:k]:
            if (a ^ b).bit_count() <= 2:
                assert found[a].component == found[b].component


def test_components_of_long_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)] + [(300, 299)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_edges(edge_docs, no_docs):
    rows = group(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {of[i].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert {of[i].component_id for i in (1, 2, 3)} == {1}
    assert of[8].component_id == of[9].component_id == 8
    assert of[11].fingerprint == of[12].fingerprint
    assert group(no_docs).count() == 0


def test_stage_keeps_one_of_near_copies_and_all_clean_rows(spark, edge_docs, no_docs):
    words = prose(1, 400)
    copies = [(100, words), (101, words), (102, [*words[:200], "changed", *words[201:]]), (103, [*words[:90], "x", *words[91:300], "y", *words[301:]])]
    clean = [(200 + k, prose(50 + k, 300)) for k in range(20)]
    other = (300, words[:200] + prose(9, 200))  # half of it is new
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in [*copies, *clean, other]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [100, *(i for i, _ in clean), 300]
    edges = [r.doc_id for r in near_duplicate_stage(spark, edge_docs, "").collect()]
    assert edges.count(8) == 1 and 9 not in edges and 12 not in edges and {4, 5, 6, 7, 10, 11} <= set(edges)
    assert near_duplicate_stage(spark, no_docs, "").count() == 0


def shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def alike_groups(texts, least=0.8):
    """Groups of a {key: words} table by comparing every pair."""
    sets = {k: shingles(w) for k, w in texts.items()}
    keys, parent = list(sets), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {frozenset(k for k in keys if find(k) == r) for r in {find(k) for k in keys}}


def found_groups(spark, texts):
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id bigint, text string")
    rows, groups = near_groups(docs, "doc_id", "text")
    placed = rows.join(groups.withColumnRenamed("node", "_key"), "_key", "left").selectExpr("_id", "coalesce(component, _key) g").collect()
    out = {}
    for r in placed:
        out.setdefault(r.g, set()).add(r["_id"])
    return {frozenset(x) for x in out.values()}


def test_every_near_pair_among_thousands_of_one_template(spark, monkeypatch):
    monkeypatch.setattr("structweave.llm.simhash.BLOCK", 50)
    head, foot = prose(1, 75), prose(2, 75)
    texts = {k: head + prose(1000 + k, 46) + foot for k in range(2_400)}
    for k in range(0, 400, 2):  # every second of the first is a near copy of the one before
        body = texts[k][75:-75]
        texts[k + 1] = head + body[: k % 40] + ["changed"] + body[k % 40 + 1 :] + foot
    expected = alike_groups(texts)
    assert sum(len(g) > 1 for g in expected) == 200
    assert found_groups(spark, texts) == expected


def test_stage_keeps_different_texts_of_one_id_or_of_none(spark):
    texts = [" ".join(prose(k, 60)) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3].upper()), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = near_duplicate_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])


def test_near_copies_with_many_edits(spark):
    """Copies whose fingerprints differ in more bits than any of the former masks got past."""
    texts = {}
    for k in range(40):
        words = prose(k, 250)
        texts[2 * k] = words
        texts[2 * k + 1] = [f"e{k}x{i}" if i in (40, 90, 140, 190, 240)[: 3 + k % 3] else w for i, w in enumerate(words)]
    groups = found_groups(spark, texts)
    assert groups == alike_groups(texts) and sum(len(g) == 2 for g in groups) >= 26


def test_border_cluster_makes_few_rows(spark, monkeypatch):
    """Thousands of texts of one template, on both sides of the similarity: groups as by all pairs, and no row for most pairs."""
    from structweave.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 200)
    base = prose(5, 300)
    texts = {}
    for k in range(1_500):
        words = list(base)
        for place in np.random.default_rng(k).choice(300, 4 + k % 14, replace=False):
            words[place] = f"n{k}x{place}"
        texts[k] = words
    seen = []
    monkeypatch.setattr(simhash, "saved", lambda df, label, keep=simhash.saved: (out := keep(df, label), seen.append((label, out.count())))[0])
    assert found_groups(spark, texts) == alike_groups(texts)
    pairs = [n for label, n in seen if label == "near-pairs"]
    assert len(pairs) == 2 and pairs[1] < 0.1 * 1_500 * 1_499 / 2


def test_bitmaps_bound_the_difference(spark):
    from structweave.llm.simhash import bitmaps

    texts = {k: prose(1, 40 + k) + prose(k, k) for k in range(60)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "_key bigint, _text string")
    bits = {r._key: int.from_bytes(r.bits, "big") for r in bitmaps(df, 5).collect()}
    for a in texts:
        for b in texts:
            assert (bits[a] ^ bits[b]).bit_count() <= len(shingles(texts[a]) ^ shingles(texts[b]))


def test_fingerprints_come_first_and_a_cluster_makes_no_more_rows_than_texts(spark, monkeypatch):
    """Hundreds of texts alike in most pairs: the pairs that are tried grow with the texts, not with their square."""
    from structweave.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 60)
    base = prose(5, 300)
    texts = {}
    for k in range(240):
        words = list(base)
        for place in np.random.default_rng(k).choice(300, 3 + k % 5, replace=False):
            words[place] = f"n{k}x{place}"
        texts[k] = words
    texts[240] = [*texts[0][:-1], "last"]
    seen = {}
    monkeypatch.setattr(simhash, "saved", lambda df, label, keep=simhash.saved: (out := keep(df, label), seen.setdefault(label, []).append(out.count()))[0])
    assert found_groups(spark, texts) == alike_groups(texts)
    assert seen["simhash-pairs"][0] > 0
    blocks = -(-len(texts) // 60)
    assert seen["near-open"][0] <= seen["near-mixed"][0] * blocks and seen["near-pairs"][1] < blocks * len(texts)


def test_shingles_of_the_same_texts_make_one_bucket(spark, monkeypatch):
    """A passage that texts share has many shingles with the same texts: they are compared, and sent, once."""
    from structweave.llm import simhash

    passage, texts = prose(1, 80), {}
    for k in range(12):
        texts[k] = prose(100 + k, 40 if k % 2 else 11 + k) + passage
    seen = {}
    monkeypatch.setattr(simhash, "saved", lambda df, label, keep=simhash.saved: (out := keep(df, label), seen.setdefault(label, []).append(out.collect()))[0])
    assert found_groups(spark, texts) == alike_groups(texts)
    buckets = {}
    for r in seen["near-mixed"][0]:
        buckets.setdefault(r.h, set()).add(r._key)
    assert buckets and len({frozenset(x) for x in buckets.values()}) == len(buckets)


def test_the_first_shingle_of_the_same_texts_stays(spark):
    from structweave.llm.simhash import distinct_buckets

    rows = [(h, key, 50, 10 * h + key, key % g, mine) for h, keys, g, mine in (
        (1, (1, 2, 3), 2, 0), (2, (1, 2, 3), 2, 0), (3, (1, 2), 2, 0), (4, (1, 3), 2, 0), (5, (1, 2), 1, 0), (6, (1, 2, 3), 2, 1)) for key in keys]
    df = spark.createDataFrame(rows, "h bigint, _key bigint, size int, pos int, g bigint, mine int")
    kept = {(r.h, r._key, r.pos) for r in distinct_buckets(df).collect()}
    assert kept == {(h, k, 10 * h + k) for h, keys in ((1, (1, 2, 3)), (3, (1, 2)), (6, (1, 2, 3))) for k in keys}


def test_shuffle_files_go_when_a_table_is_written(spark):
    from structweave.session import CLEAN, saved

    on_disk = lambda: {str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList().mkString("\n").split("\n") if "shuffle_" in f}
    before, conf = on_disk(), spark.conf.get(CLEAN)
    out = saved(spark.range(50_000, numPartitions=4).groupBy("id").count(), "test")
    assert not on_disk() - before and spark.conf.get(CLEAN) == conf
    assert out.count() == 50_000
