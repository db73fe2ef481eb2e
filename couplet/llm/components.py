"""Connected components by contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from couplet.operators.shared import materialise


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers
    once more, and replaces the ends of the edges by what they point at; edges inside one component
    vanish. Rounds end when no edge is left, after about the logarithm of the longest path. Edges
    with a null end are ignored. Every round is written to the shared folder.
    """
    live = materialise(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"),
                                    (F.col(left) != F.col(right)).alias("real"))
                       .where(F.col("real")).select("a", "b").distinct())
    labels = None
    while live.limit(1).count():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = materialise(both.groupBy("node").agg(F.min("other").alias("other"))
                            .select("node", F.least("node", "other").alias("up")))
        # The node pointed at has an edge too, so it has a pointer of its own.
        pointer = materialise(first.join(first.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
                              .select("node", F.col("top").alias("up")))
        if labels is None:
            labels = pointer.select("node", F.col("up").alias("component"))
        else:
            moved = labels.join(pointer.select(F.col("node").alias("component"), "up"), "component", "left")
            labels = materialise(moved.select("node", F.coalesce("up", "component").alias("component")))
        ends = [pointer.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b")]
        live = materialise(live.join(ends[0], "a").join(ends[1], "b")
                           .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
                           .where("a != b").distinct())
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
