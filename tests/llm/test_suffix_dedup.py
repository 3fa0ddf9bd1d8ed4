import hashlib
from collections import Counter

import pytest

from structweave.llm.suffix_dedup import cut_text, op4_suffix_dedup, removed_spans, runs, suffix_dedup_stage

from .conftest import EDGES, prose


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + 200] for b in texts for p in range(len(b) - 199))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        marked = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                marked[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(b, marked, strict=True) if not m)
        spans = sum(1 for k in range(len(b)) if marked[k] and (k == 0 or not marked[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, written, rows):
    path = written(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in op4_suffix_dedup(spark, path).collect()), key=str) == brute(rows)


def test_query_against_brute_force(spark, sf, written):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, written, rows)


def test_edges_and_planted_passages(spark, written):
    passage = " ".join(prose(5, 60))
    rows = [(i, t if t is None or len(t) < 9_000 else t[:9_000]) for i, t, _ in EDGES]
    rows += [(100 + k, " ".join(prose(60 + k, 80)) + " " + passage[k:] + " " + " ".join(prose(90 + k, 40))) for k in range(6)]
    rows += [(200, "ab" * 400), (201, "ab" * 130 + "é" * 120), (202, passage[:199]), (203, passage[:200]), (204, passage + passage)]
    check(spark, written, rows)


def test_no_rows(spark, written):
    check(spark, written, [])


@pytest.mark.parametrize("text", [b"x" * 1_000, bytes(range(256)) * 20, b"short"])
def test_runs_hold_every_window_once(text):
    held = sorted(p for part in runs(text) for s, n in zip(part[0].tolist(), part[1].tolist(), strict=True) for p in range(s, s + n))
    assert held == list(range(max(0, len(text) - 199)))


def test_spans_and_cut():
    assert removed_spans([10, 300, 5], [3, 1, 1]) == [(5, 212), (300, 500)]
    assert cut_text("aéb", [(0, 2)]) == "b"  # the é that the span touches goes


def test_stage_cuts_repeats_and_keeps_clean_documents(spark, edge_docs, no_docs):
    passage = " ".join(prose(5, 60))
    rows = [(k, " ".join(prose(10 + k, 50)) + f" {passage} " + " ".join(prose(30 + k, 50)), "en", "s", 3) for k in range(4)]
    rows += [(50 + k, " ".join(prose(70 + k, 100)), "en", "s", 3) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = suffix_dedup_stage(spark, docs, "")
    assert out.schema.names == docs.schema.names
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == 9
    for i, text, *_ in rows:
        assert (found[i].text == text) == (i >= 50)
        assert passage[30:-30] not in found[i].text
    left = [r.doc_id for r in suffix_dedup_stage(spark, edge_docs, "").collect()]
    assert 8 not in left and 10 not in left and left.count(None) == 2  # copies and the run of one letter are gone
    assert suffix_dedup_stage(spark, no_docs, "").count() == 0
