"""The stages one after another, each held against what its own input says."""

import corpus_pipeline

from .test_packing import check


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({t for _, t in texts}) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check(packed, texts)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
