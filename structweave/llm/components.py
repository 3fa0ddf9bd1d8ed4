"""Connected components of a graph that stays in Spark: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _with_least(arcs: DataFrame) -> DataFrame:
    """(a, b, m): each arc with the least of a and its neighbours. Pre-aggregated; a hub's arcs are a skewed join."""
    least = arcs.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    return arcs.join(least, arcs["a"] == least["c"]).select("a", "b", "m")


def _facts(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b), both bigint; component: the least node reachable.

    Loops and repeated edges are allowed; an empty table gives an empty result. Each step is written to the shared
    folder, so a lost executor costs no more than a step; the step before it is deleted.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    facts = _facts(now)
    while facts[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_least(large)
        # Every a hangs on its least neighbour m, and so do its other neighbours.
        stars = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = saved(stars.where("a <> b").distinct(), "edges")
        discard(now)
        now, before, facts = after, facts, _facts(after)
        if facts == before:
            break
    members = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionAll(roots)
