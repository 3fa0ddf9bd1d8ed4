import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from structweave.llm.packing import combinations, encoder, op7_packing, pack, plan, solve

from .conftest import EDGES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, texts, window=1024):
    """Every id in exactly one piece, sequences gapless from 0; returns the share of padding."""
    left = {}
    for i, t in texts:
        left.setdefault(i, []).append(ids_of(t))
    covered = {}
    for r in rows:
        assert any(r.doc_tokens == len(a) and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for a in left[r.doc_id])
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {i: sum(map(len, a)) for i, a in left.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(total, 1)


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(op7_packing(spark, sf).collect(), texts) < 0.01


def test_edges(edge_docs, no_docs):
    rows = pack(edge_docs).collect()
    check(rows, [(i, t) for i, t, _ in EDGES])
    assert {(r.start, r.length) for r in rows if r.doc_id in (1, 2)} == {(0, 1)}
    assert pack(no_docs).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> a <|endoftext|>", "tabs\t\tand\n\n lines ", "don't I'll WE'RE", "漢字\U0001f600é", "x" * 3_000, " ", "\x00\x1f"])
def test_ids_are_those_of_the_tokenizer(text):
    assert encoder().encode(text, allowed_special="all") == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(0)
    for histogram in (r.integers(0, 50, 1025), r.integers(0, 2, 1025), np.eye(1025, dtype=int)[700] * 999, np.zeros(1025, int)):
        histogram[0] = 0
        used = np.zeros(1025, int)
        sequences = 0
        made, whole = plan(histogram)
        cut = histogram - whole
        assert (cut >= 0).all() and not cut[:513].any() and not cut[1024]
        for parts, n in made:
            assert sum(parts) <= 1024
            sequences += n
            for p in parts:
                used[p] += n
        pieces = whole.copy()
        pieces[512] += cut.sum()
        pieces[1:513] += cut[513:]
        assert (used == pieces).all()
        if histogram.sum() > 10_000:
            assert sequences * 1024 < 1.002 * (histogram * np.arange(1025)).sum()


def test_least_squares_finds_an_exact_mix():
    lengths = np.array([24, 100, 400, 500, 624, 1000])
    patterns = combinations(lengths, 1024)
    assert {tuple(sorted(p[p > 0])) for p in patterns} == {(24, 1000), (400, 624), (24, 500, 500)}
    wanted = {(1000, 24, 0): 30, (624, 400, 0): 12, (500, 500, 24): 7}
    histogram = np.zeros(1025)
    for p, n in wanted.items():
        for length in p:
            histogram[length] += n
    x = solve(patterns, histogram)
    for p, n in zip(patterns.tolist(), x, strict=True):
        assert n == pytest.approx(wanted[tuple(p)], abs=0.05)
