"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouping with map-side combine, written to the shared folder, and a join against its one row a node: both sides of
that join are plain scans, so AQE splits a node with very many edges. What is written cuts the lineage and survives lost
executors; tables of a finished step are deleted. The number of rounds grows with the logarithm of the longest path.
Only two counts a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour, itself included; distinct."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    moved = both.filter("v > u").join(least.hint("merge"), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    out = stored(moved.filter("u != v").distinct(), "large-star")
    discard(least)
    return out


def _small_star(down: DataFrame) -> DataFrame:
    """``down(u, v)`` with v < u: links a node and its smaller neighbours to the smallest of them; distinct."""
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least.hint("merge"), "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = stored(moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``node, component``: a row for every node that has an edge; the component is its smallest node.

    Null ends and loops are ignored; edges may repeat and have either direction; an empty table gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b and a is not null and b is not null").distinct()
    current, before = stored(edges, "edges"), None
    for _ in range(MOST_ROUNDS):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if state == before or not state[0]:
            break
        last, before = current, state
        large = _large_star(current)
        current = _small_star(large)
        discard(last, large)
    else:
        raise RuntimeError("components have not settled")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
