"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lekhya.session import stage

EDGES = 200_000  # of a round that are written by one task


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"),
                                                          F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b); component: its smallest node.

    The steps keep one edge per node in the end.  Each round is written to the shared folder;
    hubs are met by pre-aggregated minima.  Edges of a node with itself are ignored.
    """
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
    edges = stage(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        now = edges.agg(*mark).first()
        if now == before or not now[0]:
            break
        parts = 1 + now[0] // EDGES  # few edges need few files
        before, edges = now, stage(_small_star(_large_star(edges)).coalesce(parts))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
