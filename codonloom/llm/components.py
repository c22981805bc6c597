"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.llm.common import cut, split_join


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return split_join(both, least, ["a"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = split_join(edges, least, ["a"]).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) of longs touches and that is
    not itself the smallest node of its component.

    Rounds of large and small stars (Kiveris et al., 2014) until the edges are
    stars. Each round is written to the checkpoint folder; the driver sees a count
    and a checksum only. Self-loops and repeated edges change nothing.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    now, before = cut(ordered), None
    while True:
        r = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(r) == before or not r[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(r)
        now = cut(small_star(large_star(now)), r[0])  # a round never adds edges
