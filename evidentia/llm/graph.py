"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import staged


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, label)`` for every end of ``edges(a, b)``; label is the smallest id of the component.

    Each round points every node at its smallest neighbour (or itself, where it is smaller), follows these pointers
    once more, and contracts the edges to what is pointed at.  At least half of the nodes go in a round, and the edges
    shrink with them.  Pointers are minima, combined before the shuffle; a hub's edges meet its pointer in a join of two
    staged tables, which adaptive execution can split.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(most_rounds):
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        point = staged(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("to")), "point")
        onward = point.select(F.col("id").alias("to"), F.col("to").alias("then"))
        point = staged(point.join(onward, "to").select("id", F.col("then").alias("to")), "jumped")
        if labels is None:
            labels = point.withColumnRenamed("to", "label")
        else:
            moved = point.select(F.col("id").alias("label"), "to")
            labels = staged(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        to_a, to_b = point.select(F.col("id").alias("a"), F.col("to").alias("x")), point.select(F.col("id").alias("b"), F.col("to").alias("y"))
        left = edges.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = staged(left.distinct(), "edges")
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
