"""Connected components as a distributed union-find: least labels over edges, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each end of the edges; the component is its least node. No edges, no rows.

    Nothing is collected but one count a round: labels are a table, each node takes the least label among its
    neighbours' (a map-side combined minimum, so a node of many edges is no task's burden) and then its label's
    label. Rounds go with the logarithm of the longest chain.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x is not null and y is not null and x <> y").distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")))
    while True:
        seen = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("least"))
        near = labels.join(seen, labels["node"] == seen["x"], "left").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("top"), F.col("component").alias("above"))
        jumped = near.join(up, near["component"] == up["top"], "left").select("node", F.least("component", "above").alias("component"), "old")
        after = cut(jumped)
        changed = after.where("component <> old").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
