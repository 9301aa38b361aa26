"""Connected components of a graph too large for the driver, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows that pointer once
    more, and contracts the graph to the pointed-at nodes; the edges left shrink until
    none joins two labels.
    """
    left = cut(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        near = cut(near)
        ahead = near.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jump = cut(near.join(ahead, "to", "left").select("node", F.coalesce("then", "to").alias("label")))
        if labels is None:
            labels = jump
        else:
            step = jump.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        at_a = jump.select(F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = jump.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        joined = left.join(at_a, "a").join(at_b, "b").where("la <> lb")
        left = cut(joined.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if left.isEmpty():
            return labels
