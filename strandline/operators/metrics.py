"""Evaluation: entropy, rates at k, rank statistics."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Ranges of scores, a task each.
RANGES = 64


def entropy(rows: DataFrame, bucket: str) -> DataFrame:
    """Shannon entropy in bits of a column's values: one row ``entropy``."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg((-F.sum(share * F.log2(share))).alias("entropy"))  # total is one row


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks, from counts per distinct score: one row ``n_pos, n_neg, auc``; null where a side has no row. Null scores don't count."""
    per = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive) == 1).alias("p"), F.count_if(F.col(positive) == 0).alias("q"))
    # scores are dealt into ranges by quantiles; a range adds up what lies below it, and within a range a window does
    cuts = per.approxQuantile("s", [i / RANGES for i in range(1, RANGES)], 0.1 / RANGES) if RANGES > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("s"))) if cuts else F.lit(0)
    per = per.withColumn("place", place)
    every = per.groupBy("place").agg(F.sum("q").alias("q"))  # RANGES rows at most
    base = every.withColumn("base", F.coalesce(F.sum("q").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("q")
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("place").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per, below = per.withColumn("inside", inside).join(F.broadcast(base), "place"), F.col("base") + F.col("inside")
    wins = per.withColumn("below", below).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"))
    return wins.select("n_pos", "n_neg", F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def rank_sums(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Mann-Whitney: one row ``n_pos, n_neg, u_pos, u_neg, z, effect`` (normal approximation without a correction for ties; ``effect`` is z over the root of the rows)."""
    n, m, u = F.col("n_pos"), F.col("n_neg"), F.col("auc") * F.col("n_pos") * F.col("n_neg")
    z = F.try_divide(u - n * m / 2, F.sqrt(n * m * (n + m + 1) / 12.0))
    return auc(rows, score, positive).select("n_pos", "n_neg", u.alias("u_pos"), (n * m - u).alias("u_neg"), z.alias("z"), F.try_divide(z, F.sqrt(n + m)).alias("effect"))


def lift(rows: DataFrame, score: str, positive: str, key: str, budgets: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75)) -> DataFrame:
    """``budget, kept, hits, recall, lift``: how many of the positive rows are among the share of rows with the highest scores, and how that compares with chance.

    ``kept`` is the budget of all rows, rounded down; ties go by key, then by hash. Rows with a null score don't count, a null ``positive`` is not positive; without a positive row
    recall and lift are null. Rows are dealt into ranges of (score, key), so equal scores spread too, and counted there; only the ranges in which a budget ends are put
    in order, each by itself. The driver holds a count for each range.
    """
    if not all(0 < b <= 1 for b in budgets):
        raise ValueError("budgets must be over 0 and up to 1")
    spark = rows.sparkSession
    each = rows.select(F.col(score).alias("s"), F.col(key).alias("k"), F.coalesce((F.col(positive).cast("double") == 1).cast("int"), F.lit(0)).alias("p")).filter("s IS NOT NULL")
    each = each.withColumn("h", F.xxhash64("s", "k", "p"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = cut(each.repartitionByRange(ranges, F.desc("s"), "k", "h").withColumn("place", F.spark_partition_id()))
    counts = sorted(each.groupBy("place").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect())  # a row a range
    total, found = sum(r.n for r in counts), sum(r.p for r in counts)
    ends, whole = [], []
    for i, b in enumerate(budgets):
        left, hits = math.floor(total * Fraction(str(b))), 0
        kept = left
        for r in counts:
            if r.n > left:
                ends.append((i, r.place, left))
                break
            left, hits = left - r.n, hits + r.p
        whole.append((i, float(b), kept, hits))
    budget = spark.createDataFrame(whole, "i int, budget double, kept long, whole long")
    last = spark.createDataFrame(ends, "i int, place int, upto long")  # a row a budget
    some = each.join(F.broadcast(last.select("place").distinct()), "place", "left_semi")
    order = Window.partitionBy("place").orderBy(F.desc("s"), "k", "h")
    part = some.withColumn("n", F.row_number().over(order)).filter("p = 1").join(F.broadcast(last), "place").filter("n <= upto").groupBy("i").agg(F.count("*").alias("more"))
    hits = F.col("whole") + F.coalesce("more", F.lit(0))
    recall = hits / F.lit(found) if found else F.lit(None).cast("double")
    return budget.join(part, "i", "left").select("budget", "kept", hits.alias("hits"), recall.alias("recall"), (recall / F.col("budget")).alias("lift"))
