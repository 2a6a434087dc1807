"""Connected components by repeated star contraction, as joins and groupings of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, longs), the component being its smallest node.

    Each round joins every edge to its larger end's smallest neighbour and then links all smaller neighbours to the
    smallest (large star, small star). Both steps keep components and end, after about log(longest path) rounds, in stars
    around the smallest node. A node's neighbours are never gathered: a round takes minima with partial sums on the
    map side and a join, whose skewed keys Spark splits. Every round is stored in the shared folder, so lineage is short
    and a lost executor costs one round. Loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = settled(_ordered(edges))
    nodes = pairs
    while True:
        large = _star(pairs, both_ways=True)
        small = settled(_star(large, both_ways=False))
        if _same(pairs, small):
            break
        pairs = small
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centers = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(members, "node", "left_anti")
    return members.unionByName(centers.select("node", F.col("node").alias("component")))


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node in ``a``, loops left out."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ordered.filter("a <> b").distinct()


def _star(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Link neighbours of each node to the smallest among them and the node: larger ones (large) or smaller ones (small)."""
    if both_ways:
        around = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = around.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.filter("a <> b").distinct()
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = pairs.join(least, F.col("a") == F.col("n")).select("b", "m")
    linked = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _same(left: DataFrame, right: DataFrame) -> bool:
    """Whether two sets of edges are equal, by count and an order-free sum of hashes."""

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    return tuple(mark(left)) == tuple(mark(right))
