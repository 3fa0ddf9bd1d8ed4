import re
from itertools import combinations

import numpy as np

from structweave.llm.decontaminate import decontamination_stage, find_overlaps, op2_decontaminate, overlap, short_masks, uncovered
from structweave.llm.words import PIECE, word_hashes

from .conftest import prose


def brute(docs, items):
    known = {}

    def words(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return np.array([known.setdefault(w, len(known)) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)], np.uint64)

    items = [(i, words(t)) for i, t in items]
    found = set()
    for d, text in docs:
        w = words(text)
        for i, v in items:
            if len(v) and any(overlap(w, v, k) for k in range(-len(v) + 1, len(w))):
                found.add((d, i))
    return found


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf).collect()} == brute(docs, items)


def test_masks_get_past_any_two_substitutions():
    assert uncovered() == []


def test_planted_passages_and_edges(spark, edge_docs, no_docs, written):
    question = prose(1, 40)
    changed = [w if k % 8 else "other" for k, w in enumerate(question)]  # seven of eight words stay
    half = [w if k % 2 else "other" for k, w in enumerate(question)]
    around = lambda w, s: " ".join([*prose(s, 60), *w, *prose(s + 1, 60)])
    rows = [(1, around(question, 10)), (2, around(changed, 20).upper()), (3, around(question[10:23], 30)), (4, around(question[10:22], 40)), (5, around(half, 50)), (6, around([], 60)), (7, "alpha beta, gamma"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = spark.createDataFrame([(100, " ".join(question)), (101, "Alpha beta gamma"), (102, None), (103, ""), (None, "no id here at all")], "item_id bigint, text string")
    found = {(r["_id"], r.item_id) for r in find_overlaps(docs, items).collect()}
    assert found == {(1, 100), (2, 100), (3, 100), (7, 101)}
    path = written(benchmark=items)
    assert sorted(r.doc_id for r in decontamination_stage(spark, docs, path).collect()) == [4, 5, 6, 8]
    assert decontamination_stage(spark, edge_docs, path).count() == edge_docs.count()
    assert find_overlaps(no_docs, items).count() == 0 and find_overlaps(docs, items.limit(0)).count() == 0


def test_words_of_long_texts_do_not_depend_on_pieces():
    text = " ".join(prose(3, 5_000)).encode()
    long = b"x " * (PIECE // 2 - 3) + text
    assert (word_hashes(long)[-5_000:] == word_hashes(text)).all()
    assert len(word_hashes(b"")) == len(word_hashes(b" .,- ")) == 0
    assert (word_hashes(b"Ab 9") == word_hashes(b"aB, 9!")).all()


def test_masks_get_past_every_fifth_word():
    for length in range(13, 26):
        assert uncovered(window=length, substitutions=length // 5) == []
    for length in range(1, 13):
        for c in combinations(range(1, length - 1), length // 5):
            assert any(set(m).isdisjoint(c) for m in short_masks(length))


def test_overlap_is_the_longest_that_starts_and_ends_equal():
    r = np.random.default_rng(5)
    for n in [*range(1, 40), *range(1, 40)]:
        equal = r.random(n) < r.choice([0.6, 0.8, 0.9])
        item = np.arange(n, dtype=np.uint64)
        doc = np.where(equal, item, np.uint64(1000))
        lengths = [b - a for a in range(n) for b in range(a + 1, n + 1) if equal[a] and equal[b - 1] and 5 * equal[a:b].sum() >= 4 * (b - a)]
        longest = max(lengths, default=0)
        found = overlap(doc, item, 0)
        assert (found[1] if found else 0) == (longest if longest >= min(13, n) else 0)


def test_substitutions_at_any_place_are_found(spark):
    places = {15: (3, 7, 11), 20: (3, 7, 11, 15), 10: (3, 6), 8: (4,), 7: (3,), 5: (2,)}
    docs, items = [], []
    for n, changed in places.items():
        words = prose(n, n)
        items.append((n, " ".join(words)))
        docs.append((n, " ".join([*prose(100 + n, 30), *("other" if k in changed else w for k, w in enumerate(words)), *prose(200 + n, 30)])))
    found = find_overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["_id"], r.item_id) for r in found} == {(n, n) for n in places}
