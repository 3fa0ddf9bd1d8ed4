"""Inputs for the operators' tests: the smallest table, written fixtures, and a table of edge cases."""

import random

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
EDGES = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", "en"), (4, "one", "en"), (5, "Two Words", None), (6, "...!!! 123 ---", "en"),
    (7, "É ü ß 漢字 \U0001f600 <|endoftext|> </s>", "fr"), (8, LONG, "en"), (8, LONG, "en"), (9, LONG, "de"), (10, "a" * 5_000, "en"),
    (11, "The same words here again and again for all of us to read in peace", "en"), (12, "the SAME words here again  and again for all of us to read in peace", "en"),
    (None, "a row without an id", None), (None, None, None),
]
#: Other columns, named like what the operators make.
EXTRA = "component_id bigint, fingerprint string, score double, _id bigint, _hash bigint, _text string, lang_pred string, sequence_id bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, lang, "s", len(t or ""), None, "x", 0.5, 7, 8, "y", "z", 9) for i, t, lang in EDGES]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def written(spark, tmp_path_factory):
    """Writes tables as a query's folder."""

    def write(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return write


def prose(seed: int, words: int, vocabulary: int = 5_000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary):x}" for _ in range(words)]


def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}
