"""Pooling, representatives, compression within a budget, and rates of an evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import runs
from .sessions import free

#: Weights of a turn by role (fixed values).
ROLES = {"user": 1.0, "assistant": 0.5, "tool_result": 0.1, "system": 0.0}


def pooled(rows: DataFrame, by: str, weight: Column, vec: str = "embedding") -> DataFrame:
    """``by, i, x``: the weighted mean of each key's vectors, of length 1; alike weights where all are 0, zeros where the mean is zero."""
    own = rows.filter(F.col(vec).isNotNull()).select(F.col(by), weight.alias("w"), F.col(vec).cast("array<double>").alias("v"))
    dims = own.select(by, "w", F.posexplode("v").alias("i", "x"))
    sums = dims.groupBy(by, "i").agg(F.sum(F.col("w") * F.col("x")).alias("a"), F.sum("w").alias("w"), F.avg("x").alias("b"))
    mean = sums.select(by, "i", F.when(F.col("w") > 0, F.col("a") / F.col("w")).otherwise(F.col("b")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(by)))  # a row a dimension
    return mean.select(by, "i", F.when(norm > 0, F.col("x") / norm).otherwise(0.0).alias("x"))


def role_weight(role: str = "role") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col(role)), F.lit(0.0))


def within_budget(items: DataFrame, by: str, budget: int, order: list[str], cost: str = "cost") -> DataFrame:
    """Items of each key, taken in order while they fit: what doesn't fit is passed over and later ones are still tried.

    Each choice depends on those before it, so a key is one task, which reads its items sorted and holds what is left of one budget. Null costs never fit.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, budget
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            costs = batch.column(cost).to_pylist()
            for key, lo, hi in runs(batch.column(by)):
                if (key,) != last:
                    last, left = (key,), budget
                for i in range(lo, hi):
                    if costs[i] is not None and costs[i] <= left:
                        keep[i] = True
                        left -= costs[i]
            yield batch.filter(pa.array(keep))

    dealt = items.repartition(F.col(f"`{by}`")).sortWithinPartitions(F.col(f"`{by}`"), *(F.col(f"`{c}`").asc_nulls_last() for c in order))
    return dealt.mapInArrow(choose, items.schema)


def round_robin(items: DataFrame, by: str, community: str, budget: int, order: list[str], cost: str = "cost") -> DataFrame:
    """Items of each key, one of each community in turn (communities by their best item), as long as they fit."""
    nth, place = free(items, "_nth"), free(items, "_place")
    own = Window.partitionBy(by, community).orderBy(*order)
    turn = items.withColumn(nth, F.row_number().over(own))
    best = F.min(F.struct(*order)).over(Window.partitionBy(by, community))
    placed = turn.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(nth, best)))
    return within_budget(placed, by, budget, [place], cost).drop(nth, place)


def rates(rows: DataFrame, rank: str, *by: str) -> DataFrame:
    """Shares of rows ranked first, within 3 and within 5, and the mean reciprocal rank, by every level of ``by`` and over all; null ranks are misses."""
    at = lambda k: F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)))
    return rows.rollup(*by).agg(F.count("*").alias("n"), at(1).alias("top1"), at(3).alias("top3"), at(5).alias("top5"), F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr"))


def grown(counts: DataFrame, known: DataFrame, step: float = 1.01, first: float = 0.01) -> DataFrame:
    """``src, dst, weight`` after ``n`` more uses: grown by ``step`` each, 1 at most; new ones begin at ``first``."""
    both = counts.select("src", "dst", "n").join(known.select("src", "dst", "weight"), ["src", "dst"], "full")
    now = F.coalesce("weight", F.lit(first)) * F.pow(F.lit(step), F.coalesce("n", F.lit(0)))
    return both.select("src", "dst", F.least(F.lit(1.0), now).alias("weight"))


def most_diverse(rows: DataFrame, by: str, k: int, dims: int, balance: float = 0.5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``by, key, place``: up to ``k`` vectors of each key by maximal marginal relevance to its centroid (ties: the least key); the first is the most central one."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        v = np.array([x if x is not None and len(x) == dims else [0.0] * dims for x in group[vec]], float)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        mean = v.mean(axis=0)
        to = v @ (mean / (np.sqrt(mean @ mean) or 1))
        taken: list[int] = []
        near = np.full(len(v), -np.inf)
        while len(taken) < min(k, len(v)):
            score = to if not taken else balance * to - (1 - balance) * near
            score = np.where(np.isin(np.arange(len(v)), taken), -np.inf, np.round(score, 9))
            taken.append(int(score.argmax()))
            near = np.maximum(near, v @ v[taken[-1]])
        return pd.DataFrame({by: group[by].iloc[taken].to_numpy(), key: group[key].iloc[taken].to_numpy(), "place": range(1, len(taken) + 1)})

    return rows.select(by, key, vec).groupBy(by).applyInPandas(choose, f"{by} {kinds[by]}, {key} {kinds[key]}, place int")
