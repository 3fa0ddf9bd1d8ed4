"""Reader rules on tiny files, also when a file is cut into many blocks."""

import pytest
from pyspark.sql import functions as F

from structweave.sources import corpus

FILES = {
    "ok": "-DOCSTART- -X- O O\n\na NN B O\nb NN I O\n\nc VB B P\n\n",
    "no_trailing_blank": "a NN B O\n\nb NN I O\nc NN I O\n",
    "docstart_no_blank": "-DOCSTART- -X- O O\nlost NN B O\nkept NN B O\n\n",
    "double_blank": "a NN B O\n\n\nb NN B O\n\n",
    "space_line": "a NN B O\n   \nb NN B O\n\n",
    "two_markers": "a NN B O\n\n-DOCSTART- -X- O O\n-DOCSTART- -X- O O\n\nb\tNN  B O extra\n\n",
}


def reference(text, strict=False):
    """Straight line-by-line reading: (sentences of words, number of closed sentences)."""
    sentences, current, after, closed = [], [], False, 0
    for line in text.splitlines():
        marker = line.startswith("-DOCSTART-")
        if marker or after:
            after = marker
            continue
        if not line.strip():
            sentences.append(current)
            closed += 1
            current = []
        else:
            current.append(line.split()[0])
    if current and not strict:
        sentences.append(current)
    return [s for s in sentences if s], closed


@pytest.mark.parametrize("block_bytes", [7, 23, 1 << 20])
def test_reader(spark, tmp_path, block_bytes):
    for name, text in FILES.items():
        (tmp_path / f"{name}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        numbered = corpus.number_sentences(corpus.scan_lines(spark, str(tmp_path)))
        closed = {r.file.split("/")[-1][:-4]: r.n for r in numbered.groupBy("file").agg(F.expr("count_if(is_break) as n")).collect()}
        for strict in (False, True):
            found = {name: {} for name in FILES}
            for t in sorted(corpus.sentence_tokens(numbered, strict).collect(), key=lambda t: (t.sent, t.pos)):
                found[t.file.split("/")[-1][:-4]].setdefault(t.sent, []).append((t.pos, t.word))
            for name, text in FILES.items():
                words, n = reference(text, strict)
                assert [[w for _, w in s] for s in found[name].values()] == words, name
                assert all([p for p, _ in s] == list(range(len(s))) for s in found[name].values())
                assert closed[name] == n
        assert corpus.sentence_count(numbered).first()[0] == sum(closed.values())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fields_beyond_the_fourth_are_ignored(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("w P C T more\n\n")
    row = corpus.read_corpus(spark, str(path)).first()
    assert (row.word, row.pos_tag, row.chunk_tag, row.tag) == ("w", "P", "C", "T")


def test_several_files_are_numbered_apart(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(FILES["ok"])
    tokens = corpus.file_numbers(corpus.read_corpus(spark, str(tmp_path)))
    rows = {(r.file_no, r.sent, r.pos): r.word for r in tokens.collect()}
    assert len(rows) == 6 and {k[0] for k in rows} == {0, 1}


def test_compressed_files_and_plan(spark, tmp_path):
    """A file that cannot be split is one block; lines are numbered without being shuffled or sorted."""
    import gzip

    text = "".join(FILES.values()) * 20
    with gzip.open(tmp_path / "x.txt.gz", "wt") as out:
        out.write(text)
    numbered = corpus.number_sentences(corpus.scan_lines(spark, str(tmp_path)))
    words, closed = reference(text)
    found = {}
    for t in sorted(corpus.sentence_tokens(numbered).collect(), key=lambda t: (t.sent, t.pos)):
        found.setdefault(t.sent, []).append(t.word)
    assert list(found.values()) == words and corpus.sentence_count(numbered).first()[0] == closed
    plan = corpus.sentence_tokens(numbered)._jdf.queryExecution().executedPlan().toString()
    assert not any("line#" in line and "Exchange" in line for line in plan.splitlines())


def test_lines_and_file_names_do_not_go_to_python(spark, tmp_path):
    """Fields are split as by the regular expression, and lines stay in Spark while sentences are numbered."""
    odd = ["a\tb c d", "  x NN  B O", "x NN B O ", "w P C T", "　q P C T", "é P C T", "a\x1cb c d", "only", " ", "\x1f \t", " "]
    (tmp_path / "x.txt").write_text("\n".join(odd) + "\n", encoding="utf-8")
    numbered = corpus.number_sentences(corpus.scan_lines(spark, str(tmp_path)))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert not any("MapInArrow" in row and "line#" in row for row in plan.splitlines())
    space, blank = r"(?U)[\s\x1c-\x1f]+", r"(?U)^[\s\x1c-\x1f]*$"
    lines = numbered.select("line", "is_token", corpus._fields(F.col("line")).alias("got"))
    wanted = F.split(F.regexp_replace("line", "(?U)^[\\s\\x1c-\\x1f]+", ""), space)
    rows = lines.select("*", wanted.alias("want"), F.col("line").rlike(blank).alias("blank")).collect()
    assert len(rows) == len(odd) and all(r.got == r.want and r.is_token != r.blank for r in rows)
