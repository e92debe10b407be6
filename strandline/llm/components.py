"""Connected components by minimum labels with pointer jumping, all in joins and sums by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every node with an edge; the label is the least node of its component.

    Rounds end when no label changes; labels halve their distance each round, so rounds grow
    with the logarithm of the longest chain. Each round is written to the shared folder, which
    bounds lineage and survives lost executors. Null ends are left out; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = cut(both.union(both.select("y", "x")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = cut(step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        drop(labels)
        labels = step.select("node", "label")
        if step.filter("was <> label").isEmpty():
            drop(both)
            return labels
