"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in
    ``edges`` (``a, b``). Each round takes the least label of the neighbours and
    then the label of that label; the labels are written to the shared folder
    between rounds, and only the number of changes reaches the driver."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        told = (both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        lower = labels.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        hop = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        moved = materialize(lower.join(hop, "new").select("node", "old", F.least("new", "far").alias("component")), "labels")
        labels = moved.drop("old")
        if moved.filter("old != component").isEmpty():
            return labels
