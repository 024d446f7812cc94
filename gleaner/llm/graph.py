"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.session import cut


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``links (a, b)``, which must not be null.

    In each round every node moves to that node of its closed neighbourhood that a hash,
    new in each round, puts first; links between moved nodes go on to the next round. The
    rounds grow with the logarithm of the nodes. Moves are minima, reduced before the
    shuffle, so a node with many links arrives as one row per task.
    """
    edges = cut(_tidy(links), "links")
    moves = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), c.alias("n"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        to = F.least(F.col("m"), rank(F.col("node")))
        moved = cut(nearest.select("node", to.getField("n").alias("root")), "moves")
        moves.append(moved)
        left = edges.join(moved.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        ends = left.join(moved.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = cut(_tidy(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves.pop()
    while moves:  # a node's root is where its move's target went later, if it went on
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = moves.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return cut(found, "components")


def _tidy(links: DataFrame) -> DataFrame:
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
