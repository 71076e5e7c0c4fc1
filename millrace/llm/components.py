"""Connected components by alternating large-star and small-star rounds.

A large-star round links each node's larger neighbours to its smallest neighbour, a small-star round links its smaller
neighbours and itself to the smallest; in the end each component is a star around its smallest node. Each round is a join and an
aggregation over edges, with partial minima before the shuffle. The minima are one row a node; a hub's edges may meet in one partition
of the join, which adaptive execution splits, as any partition that is much larger than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of ids, in any direction, repeated or not: (node, component) of each node that has an edge to another;
    component is the smallest node reachable. Rows with a null are no edges; no edges give an empty result."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = settle(edges, "edges")
    state = _state(edges)
    while True:
        after = settle(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        discard(edges)
        edges, before, state = after, state, _state(after)
        if state == before:  # the last table goes when the application ends
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
