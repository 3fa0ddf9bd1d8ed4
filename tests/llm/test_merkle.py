import hashlib

from structweave.llm.merkle import compare_edited, edited, edits, likeness, op8_merkle, tree

from .conftest import EDGES, by_id, prose


def brute(rows):
    """(id, n_chars, digest) in order of id, null ids first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), tree(text.encode()).text(), tree(new.encode()).text()))
    return out


def test_query_against_brute_force(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op8_merkle(spark, sf).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows) == brute(texts)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    long = [r for r in rows if r.n_chars > 1_000]
    assert sum(r.near_edited > 0.3 for r in long) > 0.9 * len(long) and sum(r.near_next < 0.3 for r in long) > 0.9 * len(long)


def test_ranges_of_any_size_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, compare_edited(docs).collect()))
    monkeypatch.setattr("structweave.llm.merkle.RANGE_CHARS", 20_000)
    assert sorted(map(tuple, compare_edited(docs.repartition(5)).collect())) == whole


def test_edges(spark, edge_docs, no_docs):
    rows = compare_edited(edge_docs).collect()
    assert len(rows) == len(EDGES)
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[1].fingerprint == of[2].fingerprint != of[3].fingerprint and of[1].near_next == 1.0
    assert of[8].fingerprint == of[9].fingerprint and of[11].fingerprint != of[12].fingerprint
    assert compare_edited(no_docs).count() == 0
    alone = compare_edited(edge_docs.where("doc_id = 11")).first()
    assert alone.near_next == 1.0


def test_equal_roots_and_located_edits():
    paragraphs = [". ".join(" ".join(prose(10 * p + s, 12)) for s in range(4)) + "." for p in range(40)]
    text = "\n".join(paragraphs)
    other = text.replace(paragraphs[20], paragraphs[20].replace(" ", " X ", 1))
    a, b = tree(text.encode()), tree(other.encode())
    assert a.root == tree(text.encode()).root != b.root
    assert sum(n for _, n in a.leaves()) == len(text.encode())
    place = text.index(paragraphs[20])
    assert all(place <= s and e <= place + len(paragraphs[20]) + 1 for s, e in edits(a, b)) and edits(a, b)
    assert edits(a, a) == [] and 0.95 < likeness(a, b) < 1 and likeness(a, tree(b"")) == 0 and likeness(tree(b""), tree(b"")) == 1
    shifted = tree(("A new first line.\n" + text).encode())
    assert likeness(a, shifted) > 0.95
    assert edited("abcde", "XYZ") == "abcXY" and edited("", "X") == "" and edited("ab", "") == "a"
    run = b"no stop " * 3_000
    assert max(n for _, n in tree(run).leaves()) <= len(run) and by_id
