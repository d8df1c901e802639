"""Connected components by alternating large and small stars.

Each round ends in a table in the shared folder. The least neighbour of each node is broadcast while there are few edges, and
written before it is joined beyond: both sides of the join are then plain exchanges, which adaptive execution splits where
one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch

#: Edges up to which the least neighbours are broadcast (some 100 bytes each).
BROADCAST_EDGES = 100_000


def _large_star(edges: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
    stars = both.filter(F.col("root") > F.col("node")).join(F.broadcast(least) if few else scratch.save(least), "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
    return stars if few else scratch.save(stars)


def _small_star(edges: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.filter(F.col("root") < F.col("node"))
    least = down.groupBy("node").agg(F.min("root").alias("m"))
    least = least if few else scratch.save(least)
    moved = down.join(F.broadcast(least) if few else least, "node").filter(F.col("root") != F.col("m")).select(F.col("root").alias("node"), F.col("m").alias("root"))
    return moved.unionByName(least.select("node", F.col("m").alias("root")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for each node of the edges (a, b) that is not the least of its component; root is that least node.

    The result is a table of ``scratch``.
    """
    start = scratch.count
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node != root").distinct())
    n, state = edges.count(), None
    while True:
        few = n <= BROADCAST_EDGES
        stars = scratch.save(_small_star(_large_star(edges, scratch, few), scratch, few).distinct())
        scratch.drop_but(stars, since=start)
        n, total = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if (n, total) == state:
            return stars
        edges, state = stars, (n, total)


def extended(roots: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The components' roots (node, root) with further edges (a, b); only the components that these join change."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between, scratch)
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    kept = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return scratch.save(kept.unionByName(joined))
