"""Connected components of a sparse graph by alternating large-star and small-star rounds.

Every round is two joins of the edges with a partially aggregated minimum per node; each round's
edges are checkpointed in the shared folder. Nothing is collected but one (count, hash) row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs`` (u, v): point every v (for small stars also u itself) to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = pairs.join(least, "u")
    out = met.filter(F.col("v") > F.col("u")) if not small else met
    edges = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        edges = edges.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return edges.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes that have an edge; ``edges`` has columns a, b of one orderable type. The component is its least node.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    state = None
    while True:  # ends at the fixed point; rounds grow with the logarithm of the longest path
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.bit_xor(F.hash("a", "b")).alias("s")).first()
        if mark["n"] == 0 or tuple(mark) == state:
            break
        state = tuple(mark)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, small=False)
        edges = checkpointed(_star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), small=True))
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
