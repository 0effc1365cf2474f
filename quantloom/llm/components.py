"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut


def star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on ``edges(u, v)`` with u > v: link each node's larger (or smaller) neighbours to its least one."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = both.join(least, "u")
    if small:  # each neighbour and the node itself go to the least neighbour
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (longs); root is the least node reachable.

    Self-loops and repeated edges do not matter. The rounds grow with the logarithm of the
    longest chain; each one is checkpointed, and what reaches the driver is a count and a checksum.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        now = cut(star(star(now, small=False), small=True))
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cut(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
