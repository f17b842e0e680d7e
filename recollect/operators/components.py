"""Connected components of an edge table, by hooking to the smaller neighbour and contracting.

Each round hooks every node that has a smaller neighbour to its smallest one, relabels the edges and drops
those inside one label. Stars end after one round, chains after a number of rounds logarithmic in practice.
Edges and labels stay distributed and are written to the shared folder each round. No edge and no node is
dropped; repeated edges and self-loops are harmless; an empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, scratch


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that never sends a side through the driver: Spark takes exploded or well packed tables for small ones and would broadcast them."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _open(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node that is not its own root."""
    with scratch(edges.sparkSession) as keep:
        return keep(_contracted(edges), "components")


def _contracted(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.col("a").alias("a"), F.col("b").alias("b"))
    left = materialise(_open(edges), "edges")
    labels = None
    while not left.isEmpty():
        hook = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        # one jump: where the target hooks on, follow it
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("farther"))
        hook = materialise(merged(hook, far, "to", "left").select("node", F.coalesce("farther", "to").alias("to")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("root"))
        else:
            moved = merged(labels, hook.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = materialise(moved.unionByName(hook.select("node", F.col("to").alias("root"))), "labels")
        for side in ("a", "b"):
            left = merged(left, hook.select(F.col("node").alias(side), F.col("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        left = materialise(_open(left), "edges")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node that another followed in the round it hooked itself may hook again; its entries end at one root
    return labels.distinct()
