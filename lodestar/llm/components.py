"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges (16 bytes each) of which the smallest neighbours are broadcast; more are joined by a shuffle.
BROADCAST_EDGES = 500_000


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: a, b (long). Returns id, root: each id with the smallest id that it is connected to.

    Alternates two steps until no edge changes: every neighbour above a node joins the node's smallest neighbour, then
    a node and its smaller neighbours join the smallest of them. The smallest is a partial aggregate that is joined back,
    so that a node with very many neighbours is no large group. Rounds grow with the logarithm of the longest path.
    """
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.put(ordered.distinct(), f"{name}-0")
    before, turn = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first(), 0
    while True:
        turn += 1
        few = (lambda df: F.broadcast(df)) if before[0] <= BROADCAST_EDGES else (lambda df: df)
        # Every edge goes from a node to a smaller one: a node's smallest neighbour is over both ends, or itself.
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        least = ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = edges.join(few(least.select(F.col("x").alias("b"), "m")), "b").select("a", F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(few(small), "a")
        out = joined.select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = scratch.put(out.where("a != b").distinct(), f"{name}-{turn}")
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
