import re

from structweave.llm.license_scan import BASE, op6_license_scan, rare_words, scan

from .conftest import EDGES, by_id


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for k in range(len(words)) for phrase, label in BASE if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query_against_brute_force(spark, sf):
    found = by_id(op6_license_scan(spark, sf))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert row(found[r.doc_id]) == brute(r.text)
        assert set(filter(None, found[r.doc_id].base_labels.split(","))) <= set(filter(None, found[r.doc_id].labels.split(",")))


def test_edges_and_templates(spark, edge_docs, no_docs):
    texts = {
        1: "Released UNDER the MIT-license; cc by nc cc by nc. Apache License, Version 2.0 (apache license version 2)",
        2: "mit license the under", 3: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        4: "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files", 5: "gnu and general and public", 6: "under the mit licensé", 7: None,
    }
    rows = [(i, t, 0.5, "clash") for i, t in texts.items()]
    found = by_id(scan(spark.createDataFrame(rows, "doc_id bigint, text string, score double, line string")))
    for i, t in texts.items():
        assert row(found[i]) == brute(t)
    assert found[1].labels == "apache-2,cc-by-nc,mit" and found[1].score == 1.0
    assert found[3].labels == "gpl" and found[4].labels == "mit"
    assert {(found[i].labels, found[i].score) for i in (2, 5, 6, 7)} == {("", 0.0)}
    rows = scan(edge_docs).collect()
    assert sorted(map(str, (row(r) for r in rows))) == sorted(map(str, (brute(t) for _, t, _ in EDGES)))
    assert scan(no_docs).count() == 0


def test_rarest_words_are_chosen():
    chosen = rare_words(["the of rare common words in a long phrase", "the odd"], 100, {"the": 100, "of": 90, "in": 95, "a": 99, "common": 50})
    assert {w for t, _, w, _ in chosen if t == 0} == {"rare", "words", "long", "phrase"}
    assert sum(x for t, *_, x in chosen if t == 1) == 1.0


def test_only_native_operators(spark, sf):
    plan = op6_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
