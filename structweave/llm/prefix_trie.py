"""Prefix trie over conversations as a burst trie: containers of suffixes under trie heads.

A conversation is the path of its turn ids. Equal paths become one row with a count. All paths start in one container;
a container with too many turns bursts by the next turn id after what its paths have in common, which becomes a trie head.
Containers that are small enough are dealt over the tasks, sorted and swept into nodes; heads are added up from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, discard, saved, table

#: Turns (and paths) that a container of several paths holds at most.
CONTAINER = 4_096
#: Hexadecimal digits of a turn id.
TURN = 32
#: Characters of ids that one piece of a list of members holds.
PIECE = 1 << 20
SHARED, MAX_SHARED = 20, 4
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_SWEPT = _NODE + ", line array<string>"


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of a cryptographic hash, so texts made to collide do not merge turns."""
    return F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(TURN))


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(_conv, _turns array<struct<turn, id, words>>) in order of turns, a null turn first; equal turns by their id.

    Null roles and texts count as empty; rows without a conversation id belong to none. Only ids and counts are gathered.
    """
    plain = rows.select(
        F.col("conv_id").cast("bigint").alias("_conv"), F.col("turn").cast("bigint").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    ).where(F.col("_conv").isNotNull())
    words = F.regexp_count("_text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")
    turns = plain.select("_conv", F.struct(F.col("_turn").alias("turn"), turn_id(F.col("_role"), F.col("_text")).alias("id"), words.alias("words")).alias("_t"))
    # Neighbours that share turns land in one partition, so the join with the lender needs no further shuffle.
    near = turns.withColumn("_lender", F.col("_conv") - F.col("_conv") % SHARED).repartition("_lender")
    return near.groupBy("_lender", "_conv").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))


def rebuilt_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, words): the first h turns of conversation c - c % 20, then c's own from h on; h = crc32(c) % 4."""
    own = conversation_turns(rows)
    lent = own.where(F.col("_conv") == F.col("_lender")).select("_lender", F.slice("_turns", 1, MAX_SHARED - 1).alias("_lent"))
    both = own.join(lent, "_lender", "left")
    h = F.pmod(F.crc32(F.col("_conv").cast("string")), F.lit(MAX_SHARED)).cast("int")
    first = F.coalesce(F.slice("_lent", F.lit(1), h), F.slice("_turns", 1, 0))
    rest = F.slice("_turns", h + 1, F.size("_turns"))
    turns = both.select(F.col("_conv").alias("conv_id"), F.concat(first, rest).alias("_turns"))
    return turns.select("conv_id", F.array_join(F.col("_turns.id"), "").alias("path"), F.col("_turns.words").alias("words"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(path, words, n, conv_id, ends): equal paths as one row, with the least id and the hash of all ids in order.

    The ids of a path are sorted over range partitions, so copies without end are written by many tasks; they meet as
    pieces of a megabyte, which one task hashes one after the other.
    """
    piece = pa.schema([("path", pa.string()), ("words", pa.list_(pa.int64())), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    whole = pa.schema([("path", pa.string()), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])

    def weigh(row) -> int:
        return len(row[0]) + len(row[-1]) + 8 * len(row[1]) + 64

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        path, words, ids, size = None, None, [], 0
        for batch in batches:
            for conv, at, found in zip(batch["conv_id"].to_pylist(), batch["path"].to_pylist(), batch["words"]):
                if at != path or size > PIECE:
                    if ids:
                        yield path, words, ids[0], len(ids), ",".join(map(str, ids))
                    path, words, ids, size = at, found.as_py(), [], 0
                ids.append(conv)
                size += 20
        if ids:
            yield path, words, ids[0], len(ids), ",".join(map(str, ids))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        path = words = first = digest = None
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if n:
                        yield path, words, n, first, digest.hexdigest()
                    path, words, first, n, digest = row["path"], row["words"], row["first"], 0, hashlib.sha256()
                digest.update((("," if n else "") + row["ids"]).encode())
                n += row["n"]
        if n:
            yield path, words, n, first, digest.hexdigest()

    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    cut = ordered.mapInArrow(lambda b: batched(pieces(b), piece, weigh), "path string, words array<bigint>, first bigint, n bigint, ids string")
    met = cut.repartition("path").sortWithinPartitions("path", "first")
    return met.mapInArrow(lambda b: batched(hashed(b), whole, weigh), "path string, words array<bigint>, n bigint, conv_id bigint, ends string")


def _crowded(active: DataFrame, limit: int) -> DataFrame:
    """Containers that burst: (key, head, line, depth, last, before).

    ``head`` names the node chain from ``depth`` to ``last`` turns that all paths of the container share; ``line`` the
    heads above it and itself; ``before`` sums the words of the chain's nodes above each of them.
    """
    sizes = active.groupBy("key", "cut", "line").agg(
        F.count(F.lit(1)).alias("_paths"), F.sum(F.size("words") + 1).alias("_size"),
        F.min(F.struct("path", "words")).alias("_least"), F.max("path").alias("_most"),
    )
    schema = pa.schema([("key", pa.string()), ("head", pa.string()), ("line", pa.list_(pa.string())), ("depth", pa.int64()), ("last", pa.int64()), ("before", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                least, depth = row["_least"], row["cut"]
                last = len(commonprefix([least["path"], row["_most"]])) // TURN
                before = [0]
                for k in range(depth, last):
                    before.append(before[-1] + (least["words"][k - 1] if k else 0))
                head = hashlib.sha256(row["key"].encode()).hexdigest()[:TURN]
                # The words of the last node close the list: its own sum is the last entry.
                before.append(before[-1] + (least["words"][last - 1] if last else 0))
                rows.append((row["key"], head, [*row["line"], head], depth, last, before))
            yield from batched(rows, schema, lambda r: len(r[0]) + 40 * len(r[2]) + 8 * len(r[5]))

    crowded = sizes.where((F.col("_paths") > 1) & (F.col("_size") > limit))
    return crowded.mapInArrow(run, "key string, head string, line array<string>, depth bigint, last bigint, before array<bigint>")


def burst(paths: DataFrame, limit: int = CONTAINER) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame]]:
    """(contained, ended, heads, written): paths with their container (``cut`` turns long, under the heads ``line``), paths
    that end at a head, the heads, and the tables to discard afterwards.

    A round per level of bursting; only paths of containers that burst are written again.
    """
    active = paths.withColumn("cut", F.lit(0).cast("bigint")).withColumn("line", F.array().cast("array<string>")).withColumn("key", F.substring("path", 1, 0))
    contained, ended, heads, written = [], [], [], []
    while True:
        crowded = saved(_crowded(active, limit), "trie-heads")
        written.append(crowded)
        if crowded.isEmpty():
            contained.append(active)
            break
        heads.append(crowded.drop("key"))
        # Rows under a hot key are split by Spark: the other side has one row per key. A broadcast follows its size.
        marked = active.join(crowded.select("key", F.col("last").alias("_last"), F.col("line").alias("_line")), "key", "left")
        ends = F.length("path") <= F.col("_last") * TURN
        cut = F.coalesce(F.col("_last") + 1, "cut")
        after = marked.select(
            "path", "words", "n", "conv_id", "ends", cut.alias("cut"), F.coalesce("_line", "line").alias("line"),
            F.when(F.col("_last").isNull(), "contained").when(ends, "ended").otherwise("active").alias("_state"),
        )
        after = saved(after.withColumn("key", F.substring(F.col("path"), F.lit(1), (F.col("cut") * TURN).cast("int"))), "trie-paths")
        written.append(after)
        contained.append(after.where("_state = 'contained'").drop("_state"))
        ended.append(after.where("_state = 'ended'").drop("_state"))
        active = after.where("_state = 'active'").drop("_state")
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return union(contained), union(ended), union(heads), written


def _nodes(rows: list[dict]) -> Iterator[tuple]:
    """Nodes of one container from its paths in order; the first is its top and carries ``line``."""
    cut, line = rows[0]["cut"], rows[0]["line"]
    depth, parent, words, convs, count, kids, leaves, kept, ends = ([] for _ in range(9))
    stack: list[int] = []
    before = ""
    for k, row in enumerate(rows):
        path = row["path"]
        turns = len(path) // TURN
        shared = len(commonprefix([before, path])) // TURN if k else cut - 1
        del stack[shared - cut + 1 :]
        for d in range(shared + 1, turns + 1):
            parent.append(stack[-1] if stack else -1)
            stack.append(len(depth))
            depth.append(d)
            words.append(row["words"][d - 1] if d else 0)
            convs.append(row["conv_id"])
            for column, start in ((count, 0), (kids, 0), (leaves, 0), (kept, 0), (ends, NO_MEMBERS)):
                column.append(start)
        last = stack[-1]
        count[last], ends[last] = row["n"], row["ends"]
        convs[last] = min(convs[last], row["conv_id"])
        before = path
    for i in range(len(depth) - 1, -1, -1):  # children stand after their parent
        leaves[i] = leaves[i] or 1
        kept[i] += (count[i] - 1) * words[i]
        if (p := parent[i]) >= 0:
            convs[p] = min(convs[p], convs[i])
            count[p] += count[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            kept[p] += kept[i]
    for i in range(len(depth)):
        above = convs[parent[i]] if i else None
        yield convs[i], depth[i], above, count[i], kids[i], leaves[i], kept[i], ends[i], None if i else line


def sweep(contained: DataFrame) -> DataFrame:
    """Nodes of all containers; the top of each has no parent yet and carries the heads above it as ``line``."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("line", pa.list_(pa.string())),
    ])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["key"] != key:
                    yield from _nodes(rows)
                    rows = []
                key = row["key"]
                rows.append(row)
        if rows:
            yield from _nodes(rows)

    dealt = contained.repartition("key").sortWithinPartitions("key", "path")
    return dealt.mapInArrow(lambda b: batched(nodes(b), schema, lambda r: 200), _SWEPT)


def _head_nodes(tops: DataFrame, ended: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, conv) of every head, and the nodes of their chains."""
    under = tops.select("line", "n_convs", "conv_id", "n_leaves", "saved_tokens")
    at = ended.select("line", F.col("n").alias("n_convs"), "conv_id", F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))
    sums = under.unionByName(at).withColumn("head", F.explode("line")).groupBy("head").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_tops"),
    )
    nearest = F.element_at("line", -1)
    below = tops.select(nearest.alias("head")).unionAll(heads.where(F.size("line") > 1).select(F.element_at("line", -2).alias("head")))
    kids = below.groupBy("head").agg(F.count(F.lit(1)).alias("_kids"))
    ends = ended.select(nearest.alias("head"), F.col("ends").alias("_ends"))
    known = saved(heads.join(sums, "head").join(kids, "head").join(ends, "head", "left"), "trie-sums")
    own = known.select(F.explode("line").alias("head"), ((F.col("n_convs") - 1) * F.element_at("before", -1)).alias("_own"))
    total = own.groupBy("head").agg(F.sum("_own").alias("_heads"))
    convs = known.select("head", "conv_id")
    parent = convs.select(F.col("head").alias("_above"), F.col("conv_id").alias("_parent"))
    full = known.join(total, "head").withColumn("_above", F.try_element_at("line", F.lit(-2))).join(parent, "_above", "left")
    chain = full.select("*", F.posexplode(F.slice("before", F.lit(1), F.size("before") - 1)).alias("_k", "_before"))
    last = F.col("depth") + F.col("_k") == F.col("last")
    return convs, chain.select(
        "conv_id", (F.col("depth") + F.col("_k")).alias("depth"), F.when(F.col("_k") > 0, F.col("conv_id")).otherwise(F.col("_parent")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("_kids")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("_tops") + F.col("_heads") - (F.col("n_convs") - 1) * F.col("_before")).alias("saved_tokens"),
        F.when(last, F.coalesce("_ends", F.lit(NO_MEMBERS))).otherwise(F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


def prefix_trie(paths: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """Every node of the trie over (conv_id, path, words), one row each; ``limit`` bounds the containers.

    An empty table has no root. A path without turns is a member of the root. Conversation ids must be distinct. A single
    path is one row, so the turns of one conversation (48 bytes each), unlike those of many, must fit into a task.
    """
    rows = saved(paths, "trie-rebuilt")
    distinct = saved(distinct_paths(rows), "trie-distinct")
    discard(rows)
    contained, ended, heads, written = burst(distinct, limit)
    nodes = saved(sweep(contained), "trie-nodes")
    columns = [c for c in nodes.columns if c != "line"]
    if heads is None:
        out = nodes.select(*columns)
    else:
        tops = nodes.where("line is not null")
        convs, chains = _head_nodes(tops, ended, heads)
        above = convs.select(F.col("head").alias("_head"), F.col("conv_id").alias("_parent"))
        placed = tops.withColumn("_head", F.element_at("line", -1)).join(above, "_head", "left").withColumn("parent_conv_id", F.col("_parent"))
        out = nodes.where("line is null").select(*columns).unionByName(placed.select(*columns)).unionByName(chains.select(*columns))
        out = saved(out, "trie")
        discard(nodes)
    for used in (distinct, *written):
        discard(used)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations")))


#: The same rows from the definition: prefixes as texts, counted one by one.
TRIE_SQL = """
with own as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
         row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null
), every as (
  select distinct c, cast(xor(list_reduce(
    list_prepend(cast(4294967295 as ubigint), flatten([[cast(ascii(ch) as ubigint), 0, 0, 0, 0, 0, 0, 0] for ch in string_split(cast(c as varchar), '')])),
    lambda a, e: xor(xor(a, e) >> 1, cast(3988292384 as ubigint) * (xor(a, e) & 1))), cast(4294967295 as ubigint)) as bigint) % 4 as h
  from own
), built as (
  select e.c, 0 as part, k, r, x from every e join own on own.c = e.c - e.c % 20 and k <= h
  union all
  select e.c, 1, k, r, x from every e join own on own.c = e.c and k > h
), turns as (
  select c, row_number() over w as d, left(sha256(length(r) || ':' || r || x), 32) as t,
         len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words
  from built window w as (partition by c order by part, k)
), steps as (
  select c, d, words, string_agg(t, '') over (partition by c order by d rows unbounded preceding) as p from turns
  union all
  select c, 0, 0, '' from every
), nodes as (
  select p, d, min(c) as conv_id, count(*) as n_convs, max(words) as words from steps group by p, d
), sizes as (select c, max(d) as d from steps group by c
), ends as (
  select p, sha256(string_agg(cast(c as varchar), ',' order by c)) as ends from steps join sizes using (c, d) group by p
), kids as (select left(p, len(p) - 32) as p, count(*) as n_children from nodes where d > 0 group by 1
), above as (
  select left(n.p, 32 * cast(unnest(range(n.d + 1)) as integer)) as p, case when k.p is null then 1 else 0 end as leaf, (n_convs - 1) * words as saved
  from nodes n left join kids k on k.p = n.p
), sums as (select p, sum(leaf) as n_leaves, sum(saved) as saved_tokens from above group by p)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, cast(coalesce(n_children, 0) as bigint) as n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from nodes n join sums s on s.p = n.p left join kids k on k.p = n.p left join ends e on e.p = n.p
left join nodes u on n.d > 0 and u.p = left(n.p, len(n.p) - 32)
"""
