"""Clusters into memories, their enrichment and digests, and what a contradiction changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars

from .sessions import free


def apply_clusters(known: DataFrame, clusters: DataFrame, by: str = "space") -> DataFrame:
    """``by, id, members, confidence, written``: the memories (``by, id, members, confidence``) of each space after its clusters (``by, members``).

    Clusters come by their least member. Each takes the memory that shares most members with it (ties: the least id; a new one has the id
    ``new-`` and its least member): the same members change nothing, others replace the memory's and raise its confidence by 0.05, to 0.99 at most. One that shares
    none becomes a memory of confidence 0.5. Later clusters see what earlier ones did, so a space is one task; it holds the clusters of one workspace.
    """
    kind = known.schema[by].dataType.simpleString()

    def one(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        work = {str(r.id): [frozenset(r.members), r.confidence, False] for r in old.itertuples()}
        holders: dict = {}
        for i, (m, *_) in work.items():
            for x in m:
                holders.setdefault(x, set()).add(i)
        for members in sorted((frozenset(m) for m in new["members"] if m is not None and len(m)), key=min):
            shared: dict = {}
            for x in members:
                for i in holders.get(x, ()):
                    shared[i] = shared.get(i, 0) + 1
            best = min(shared, key=lambda i: (-shared[i], i)) if shared else f"new-{min(members)}"
            had, confidence, _ = work.get(best, (frozenset(), 0.45, False))
            if had == members:
                continue
            for x in had - members:
                holders[x].discard(best)
            for x in members - had:
                holders.setdefault(x, set()).add(best)
            work[best] = [members, min(0.99, confidence + 0.05), True]
        return pd.DataFrame([(key[0], i, sorted(m), c, w) for i, (m, c, w) in work.items()], columns=[by, "id", "members", "confidence", "written"])

    out = f"{by} {kind}, id string, members array<bigint>, confidence double, written boolean"
    return known.groupBy(by).cogroup(clusters.groupBy(by)).applyInPandas(one, out)


def enriched(known: DataFrame, found: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """Rows with what was found about them: ``keep`` changes only where something was found, ``replace`` always for rows that were looked at."""
    looked = found.select(key, *(F.col(c).alias(f"found {c}") for c in keep + replace), F.lit(True).alias("found row"))
    new = {c: F.coalesce(f"`found {c}`", c) for c in keep} | {c: F.when(F.col("found row"), F.col(f"`found {c}`")).otherwise(F.col(c)) for c in replace}
    return known.join(looked, key, "left").select(*(new.get(c, F.col(c)).alias(c) for c in known.columns))


def with_digests(known: DataFrame, digests: DataFrame, by: str) -> DataFrame:
    """Memories after new digests (level 2, active) of some spaces: the digests they had are archived."""
    new = free(known, "_fresh")
    fresh = digests.select(by).distinct().withColumn(new, F.lit(True))
    state = F.when((F.col("level") == 2) & (F.col("state") == "active") & F.col(new), "archived").otherwise(F.col("state"))
    return known.join(fresh, by, "left").withColumn("state", state).drop(new).unionByName(digests.select(by, "id", F.lit(2).alias("level"), F.lit("active").alias("state")))


def contradicted(memories: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories (``id, confidence``) and edges (``src, dst, kind, weight``) after confirmed contradictions (``old, new``).

    The older one's confidence is updated with evidence 0.1, edges between the two keep a tenth, and an edge ``contradicts`` of weight 1 is added.
    """
    named, between = free(memories, "_hit"), free(edges, "_between")
    hit = pairs.select(F.col("old").alias("id")).distinct().withColumn(named, F.lit(True))
    confidence = F.when(F.col(named), scalars.bayes(F.col("confidence"), F.lit(0.1))).otherwise(F.col("confidence"))
    both = pairs.select(F.col("new").alias("src"), F.col("old").alias("dst"))
    ends = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn(between, F.lit(True))
    fainter = edges.join(ends, ["src", "dst"], "left").withColumn("weight", F.when(F.col(between), F.col("weight") * 0.1).otherwise(F.col("weight"))).drop(between)
    added = both.distinct().select("src", "dst", F.lit("contradicts").alias("kind"), F.lit(1.0).alias("weight"))
    return memories.join(hit, "id", "left").withColumn("confidence", confidence).drop(named), fainter.unionByName(added)


def jaccard_graph(items: DataFrame, by: str, item: str, words: str, least: float = 0.1) -> DataFrame:
    """``by, src, dst, weight``: pairs of items of one group (src < dst) by the share of their distinct words that both have, ``least`` or more.

    A group holds one question's candidates, which bounds its pairs.
    """
    each = items.select(by, item, F.array_distinct(words).alias("w")).filter(F.size("w") > 0)
    a, b = (each.select(by, F.col(item).alias(end), F.col("w").alias(f"w_{end}")) for end in ("src", "dst"))
    both = F.size(F.array_intersect("w_src", "w_dst"))  # words are distinct, so the rest of the union needs no set of its own
    pairs = a.join(b, by).filter("src < dst").select(by, "src", "dst", (F.size("w_src") + F.size("w_dst")).alias("words"), F.explode(F.array(both)).alias("both"))  # found once, for weight and filter
    return pairs.select(by, "src", "dst", (F.col("both") / (F.col("words") - F.col("both"))).alias("weight")).filter(F.col("weight") >= least)


def first_tokens(turns: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """Turns of each group from its start, up to ``most`` tokens of four characters; the turn that crosses the limit is cut."""
    room = 4 * most
    seen = free(turns, "_before")
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = turns.withColumn(seen, before).filter(F.col(seen) < room)
    return cut.withColumn(text, F.left(text, F.lit(room) - F.col(seen))).drop(seen)


def with_neighbours(kept: DataFrame, turns: DataFrame, by: str, order: str, budget: int, cost: str = "cost") -> DataFrame:
    """Kept turns and, in order, the turns right before and after them, up to the first that what is left of the budget can't hold."""
    near = kept.select(by, F.explode(F.array(F.col(order) - 1, F.col(order) + 1)).alias(order)).distinct()
    rest = turns.join(near, [by, order], "left_semi").join(kept.select(by, order), [by, order], "left_anti")
    room, upto = free(turns, "_room"), free(turns, "_upto")
    left = kept.groupBy(by).agg((F.lit(budget) - F.sum(cost)).alias(room))
    run = F.sum(cost).over(Window.partitionBy(by).orderBy(order))
    return kept.unionByName(rest.join(left, by).withColumn(upto, run).filter(F.col(upto) <= F.col(room)).drop(upto, room))
