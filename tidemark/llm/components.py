"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node by value) of each node that has an edge to another. edges: a, b long.

    Each round hooks every node to its smallest smaller neighbour and contracts the edges, so what is left shrinks by a
    factor a round where node numbers are hashes. Nothing is collected but a row count; each round's edges and
    labels are written tables.
    """
    n = edges.count()

    def put(df: DataFrame, name: str) -> DataFrame:
        return written(df, name, n, 50_000, 2)

    left = put(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = put(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while left.count():
        hooks = left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to"))
        hop = hooks.select(F.col("v").alias("to"), F.col("to").alias("to2"))
        hooks2 = hooks.join(hop, "to", "left").select("v", F.coalesce("to2", "to").alias("to"))
        a, b = (hooks2.select(F.col("v").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        moved = left.join(b, "b", "left").join(a, "a", "left").select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"))
        new = put(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        relabelled = labels.join(hooks2.select(F.col("v").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        relabelled = put(relabelled, "labels")
        remove(left)
        remove(labels)
        left, labels = new, relabelled
    remove(left)
    return labels
