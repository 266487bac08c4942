"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; the root is the least node of its component.

    Each step is an aggregate per node, combined before the shuffle and written, and a join of written tables, which
    adaptive execution may split: a node with a third of all edges costs no task its whole neighbourhood. The number of rounds grows
    with the logarithm of the longest chain. Null ends are no edges; loops and repeated edges change nothing.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    state = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = _mark(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(state: DataFrame) -> tuple:
    """Row count and a checksum that does not depend on order."""
    return tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
