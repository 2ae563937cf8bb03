"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node of the component), for every node of edges (a, b).

    Each round every node points to its least neighbour if that is less than itself, and the edges are
    rewritten between what their ends point to; edges inside one target vanish, so the table shrinks until it is
    empty. A component of at least two nodes loses half of its nodes or more in a round. Rows only:
    no adjacency list is ever gathered, and each round is written to the shared folder.
    """
    edges = cut(edges.filter("a <> b").distinct())
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")))
        if labels is None:
            labels = cut(points.select("node", F.col("to").alias("component")))
        else:
            at = points.select(F.col("node").alias("component"), "to")
            before = labels
            labels = cut(before.join(at, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            forget(before)
        left = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left_over = cut(
            edges.join(left, "a").join(right, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
        forget(edges, points)
        edges = left_over
        if edges.isEmpty():
            forget(edges)
            return labels
