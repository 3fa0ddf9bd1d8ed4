"""The prefix trie against nodes counted one by one, with containers of every size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from structweave.llm import prefix_trie as t
from structweave.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, line string, n bigint, _turns string"


def plain(rows):
    """Set of node rows from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(lender, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        words = len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = sum(saved[k] for k in kids[path]) + (len(members[path]) - 1) * words
    out = set()
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        above = min(members[path[:-1]]) if path else None
        out.add((min(cs), len(path), above, len(cs), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def held(found, rows):
    rows_found = [tuple(r) for r in found.collect()]
    wanted, n = plain(rows)
    assert len(rows_found) == n and set(rows_found) == wanted


def talk(seed, convs, kinds, longest=7):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        conv = r.choice([c, c * 7 - 40])
        for k in range(r.randrange(longest)):
            rows.append((conv, r.choice([k, k, None]), r.choice(["user", "assistant", None]), r.choice([None, "", *(f"say {i} " * (i + 1) for i in range(kinds))])))
    return rows + rows[: len(rows) // 10]


@pytest.mark.parametrize("limit", [1, 3, 12, 10_000])
@pytest.mark.parametrize("kinds", [1, 4])
def test_against_plain(spark, limit, kinds):
    rows = talk(kinds, 150, kinds)
    df = spark.createDataFrame([(*r, "p", "l", 3, "x") for r in rows], SCHEMA).repartition(5)
    held(t.prefix_trie(t.rebuilt_paths(df), limit), rows)


def test_long_shared_chains(spark):
    """A prefix of 300 turns shared by all but one, then a second one: chains of nodes between bursts."""
    long = [(1000 + c, k, "user", f"same {k}") for c in range(0, 12, 4) for k in range(300)]
    rows = long + [(1000 + c, 300 + k, "user", f"own {c // 8} {k}") for c in range(0, 12, 4) for k in range(c)] + [(5, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, "p", "l", 3, "x") for r in rows], SCHEMA)
    for limit in (1, 700, 10_000):
        held(t.prefix_trie(t.rebuilt_paths(df), limit), rows)


def test_members_in_pieces(spark, monkeypatch):
    """Copies without end: their ids are hashed piece by piece, in numeric order."""
    monkeypatch.setattr(t, "PIECE", 100)
    rows = [(c, 0, "user", "hello") for c in range(-50, 450)]
    df = spark.createDataFrame([(*r, "p", "l", 3, "x") for r in rows], SCHEMA).repartition(7)
    held(t.prefix_trie(t.rebuilt_paths(df), 10), rows)


def test_nulls_empty_and_long_texts(spark, written):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (2, 1, "user", "\U0001f600 é \x1c x"), (2, 1, "user", "\U0001f600 é \x1c x"), (None, 0, "user", "no id"),
        (40, 0, "1:a", "b"), (60, 0, "1", ":ab"), (20, 0, "user", "word " * 200_000), (-7, 5, "user", "x"), (2**63 - 1, None, "user", None), (-(2**63), 1, None, "y z"),
    ]
    df = spark.createDataFrame([(*r, "p", "l", 3, "x") for r in rows], SCHEMA)
    held(t.op11_prefix_trie(spark, written(conversations=df)), rows)
    nothing = t.op11_prefix_trie(spark, written(conversations=df.limit(0)))
    assert nothing.count() == 0 and nothing.columns[:3] == ["conv_id", "depth", "parent_conv_id"]
    assert t.op11_prefix_trie(spark, written(conversations=df.where("conv_id is null"))).count() == 0


def test_turnless(spark):
    """A conversation of as many turns as it would share, with no lender, is a member of the root alone."""
    lonely = next(c for c in range(21, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lonely, 0, "user", "a"), (lonely, 1, "user", "b"), (7, 0, "u", "x"), (7, 1, "u", "x"), (7, 2, "u", "x"), (7, 3, "u", "y")]
    df = spark.createDataFrame([(*r, "p", "l", 3, "x") for r in rows], SCHEMA)
    held(t.prefix_trie(t.rebuilt_paths(df), 1), rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    held(t.op11_prefix_trie(spark, sf), rows)


def test_sql(sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    frame = con.sql("select conv_id, turn, role, text from conversations").df()
    rows = [(int(r.conv_id), int(r.turn), r.role, r.text) for r in frame.itertuples()]
    found = con.sql(t.TRIE_SQL).df().astype(object)
    wanted, n = plain(rows)
    told = {tuple(None if pd.isna(x) else (x if isinstance(x, str) else int(x)) for x in r) for r in found.itertuples(index=False)}
    assert len(found) == n and told == wanted
