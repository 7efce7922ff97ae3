"""Connected components of an edge table by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the smallest node it is connected to.

    Self-loops, repeats and both directions may occur; edges with a null end are dropped; no
    edges give an empty result. A round hooks each node to its smallest neighbour, follows
    those hooks ``jumps`` times (each doubling the way), replaces the ends of all edges and
    drops those that fell together; rounds grow with the logarithm of the longest chain. The
    smallest node of a component always hooks to itself, so it is the one that remains.
    """
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    left = materialize(left.filter("a <> b").distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("parent")), "hooks")
        for _ in range(jumps):
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hook = hook.join(up, "parent").select("node", F.col("above").alias("parent"))
        hook = materialize(hook, "hooks")
        rounds.append(hook)
        ends = lambda c: hook.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_up"))
        moved = left.join(ends("a"), "a").join(ends("b"), "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        left = materialize(moved.filter("a <> b").distinct(), "edges")
    found = nodes.select("node", F.col("node").alias("component"))
    for hook in rounds:
        step = hook.select(F.col("node").alias("component"), F.col("parent").alias("next"))
        found = found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return found
