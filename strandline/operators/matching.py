"""Best matches and most frequent values by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, member: str) -> DataFrame:
    """For each ``left_id`` the ``right_id`` with the most common members (ties: the smallest), as ``left_id, right_id, overlap``.

    Both sides are (id, member) rows; repeated rows count once. Ids without a common member give no row.
    """
    both = left.select(left_id, member).distinct().join(right.select(right_id, member).distinct(), member)
    counts = both.groupBy(left_id, right_id).agg(F.count("*").alias("overlap"))
    best = F.min(F.struct((-F.col("overlap")).alias("n"), F.col(right_id).alias("id")))
    return counts.groupBy(left_id).agg(best.alias("b")).select(left_id, F.col("b.id").alias(right_id), (-F.col("b.n")).alias("overlap"))


def most_frequent(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of each group (ties: alphabetical) as ``by, value, freq, place``."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("freq"))
    order = Window.partitionBy(by).orderBy(F.desc("freq"), value)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def inside(edges: DataFrame, nodes: DataFrame, node: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select(node).distinct()
    return edges.join(own.withColumnRenamed(node, src), src, "left_semi").join(own.withColumnRenamed(node, dst), dst, "left_semi")


def means_of_means(rows: DataFrame, setting: str, item: str, value: str) -> DataFrame:
    """Mean over items of each item's mean, with the half width of its 95 % interval (0 for one item)."""
    items = rows.groupBy(setting, item).agg(F.avg(value).alias("m"))
    half = 1.96 * F.stddev_samp("m") / F.sqrt(F.count("*"))
    return items.groupBy(setting).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.when(F.count("*") > 1, half).otherwise(0.0).alias("half_width"))
