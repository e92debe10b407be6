"""Choosing turns by surprise and by community, before a budget is spent on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surprise(items: DataFrame, by: str, item: str, words: str) -> DataFrame:
    """``by, item, score``: the mean self-information of each item's words among the items of its group; 0 for items without words.

    Items with equal ids count as one, with the words of all.
    """
    every = items.select(by, item).distinct()
    n = every.groupBy(by).agg(F.count("*").alias("n"))
    tf = items.select(by, item, F.explode(words).alias("w")).groupBy(by, item, "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy(by, "w").agg(F.count("*").alias("df"))
    info = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    sums = tf.join(df, [by, "w"]).join(n, by).groupBy(by, item).agg((F.sum(F.col("tf") * info) / F.sum("tf")).alias("score"))
    return every.join(sums, [by, item], "left").select(by, item, F.coalesce("score", F.lit(0.0)).alias("score"))


def communities(nodes: DataFrame, edges: DataFrame, by: str, node: str) -> DataFrame:
    """``by, node, community``: each group's nodes by modularity, a community named by its least node; nodes without edges are alone.

    The two communities whose union raises modularity most are merged (ties: the least names) until none does. Edges are ``by, src, dst, weight``,
    undirected; repeated ones add up, loops and edges of unknown nodes don't count. A group holds one question's candidates and is one task.
    """
    import numpy as np

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def one(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(own[node])
        links = links[links["src"].isin(names) & links["dst"].isin(names) & (links["src"] != links["dst"])]
        label, e = np.arange(len(names)), np.zeros((len(names), len(names)))
        np.add.at(e, (np.searchsorted(names, links["src"]), np.searchsorted(names, links["dst"])), links["weight"].to_numpy(float))
        e += e.T
        e /= e.sum() or 1
        share, alive = e.sum(axis=1), np.ones(len(names), bool)
        while True:
            gain = np.where(np.triu(np.outer(alive, alive), 1) & (e > 0), np.round(e - np.outer(share, share), 12), 0)
            if not gain.size or gain.max() <= 0:
                break
            a, b = np.unravel_index(gain.argmax(), gain.shape)
            e[a] += e[b]
            e[:, a] += e[:, b]
            share[a] += share[b]
            alive[b] = False
            label[label == b] = a
        return pd.DataFrame({by: key[0], node: names, "community": names[label]})

    known = nodes.select(F.col(by).alias(by), F.col(node).alias(node)).filter(F.col(node).isNotNull())
    links = edges.select(F.col(by).alias(by), F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("weight").alias("weight"))
    # groups without nodes have nothing to say
    links = links.join(known.select(by).distinct(), by, "left_semi")
    return known.groupBy(by).cogroup(links.groupBy(by)).applyInPandas(one, f"{by} {kinds[by]}, {node} {kinds[node]}, community {kinds[node]}")
