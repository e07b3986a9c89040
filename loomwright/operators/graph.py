"""Graph operators on edge tables: connected components and ordered greedy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of ``edges`` (two columns of one orderable type).

    Large-star and small-star rounds, each one shuffle by node with a map-side minimum: every round hangs a node's larger
    neighbours, then its smaller ones, on the smallest it knows, so paths halve and stars stay stars.  No task
    holds the neighbours of a node.  Edges with a null end are dropped.  Rounds write to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    nodes = staged(pairs.select("x").union(pairs.select("y")).distinct())

    def mark(df: DataFrame) -> tuple:
        """Equal for equal edge tables."""
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("v", "u"))).first())

    current = staged(pairs.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    known = mark(current)
    while True:
        # large star: every larger neighbour of a node hangs on the node's smallest neighbour (itself included)
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours, and the node, hang on the smallest of them
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
        following = staged(small.distinct())
        current, before, known = following, known, mark(following)
        if known == before:
            break
    labels = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels, F.col("x") == F.col("u"), "left").select(F.col("x").alias("node"), F.coalesce("component", "x").alias("component"))
