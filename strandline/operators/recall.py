"""Recall as one job: lists of hits are fused, expanded over the association graph, reranked and cut, each stage degrading by itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as graphs
from . import ranking
from .lineage import cut

#: Candidates that a reranker sees at least.
POOL = 50
#: Scores are compared to so many digits.
DIGITS = 9


@dataclass
class Plan:
    """How to recall. ``settle``: ``off``, ``expand`` (new nodes join the pool) or ``channel`` (activation is a score of its own as well)."""

    limit: int = 10
    k: int = 60
    rerank_weight: float = 0.5
    activation_weight: float = 0.0
    settle: str = "off"
    hops: int = 2
    cap: int = 2000
    expansions: int = 10
    damping: float = 0.7
    failed: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.settle not in ("off", "expand", "channel"):
            raise ValueError(f"settle {self.settle!r} is none of off, expand and channel")
        if not 0 <= self.rerank_weight <= 1 or not 0 <= self.activation_weight <= 1 or self.rerank_weight + self.activation_weight > 1:
            raise ValueError("weights are 0 to 1, and 1 together at most")
        if self.limit < 1:
            raise ValueError("limit is 1 or more")


def _tried(plan: Plan, name: str, make: Callable[[], DataFrame], like: str | None = None) -> DataFrame | None:
    """What a stage gives, written out, or nothing where it fails; the failure is kept in ``plan.failed``."""
    try:
        return cut(make())
    except Exception as e:  # a stage that is down takes no other with it
        plan.failed[name] = str(e).split("\n")[0]
        return None


def recall(lists: dict[str, Callable[[], DataFrame]], plan: Plan, edges: Callable[[], DataFrame] | None = None, texts: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query, key, score, place, origin``: the ``limit`` best of each query.

    - ``lists`` (name: hits as ``query, key, score``), in the order of their tiers. A list keeps the best hit of a key and is ranked; the ranks are
      fused. A list that fails is left out and named in ``plan.failed``; with none left the recall fails.
    - ``edges`` (``src, dst, weight``) make the graph for ``settle``: hits seed it by their share of each list, and the most active nodes that are no hits and have a
      text (``texts``: ``key, text``; without it, all) join the pool with their activation. Those without a text go, but what they passed on stays.
    - ``rerank`` gets the pool (``query, key``, and ``text`` where ``texts`` is given; hits without text aren't sent) and returns ``query, key, score``, of which the best row of a key counts. Where it
      fails, and for hits it doesn't score, the fused ranks decide.

    Scores are the weighted channels over their largest of the query, ties by fused rank and key. ``origin`` is the first list a hit stood in, or ``expansion``.
    """
    if plan.settle != "off" and edges is None:
        raise ValueError("to settle, edges are needed")
    found = {name: df for name, make in lists.items() if (df := _tried(plan, name, lambda make=make: make().select("query", "key", F.col("score").cast("double").alias("score")))) is not None}
    if not found:
        raise RuntimeError(f"no list could be read: {plan.failed}")
    names = list(lists)
    each = None
    for name, df in found.items():
        best = df.groupBy("query", "key").agg(F.max("score").alias("score")).withColumn("tier", F.lit(names.index(name)))
        each = best if each is None else each.unionByName(best)
    each = cut(ranking.ranked(each, "query", "tier"))
    fused = ranking.rrf(each, plan.k, "query", "key")
    size = max(plan.limit, POOL if rerank is not None else 0)
    order = Window.partitionBy("query").orderBy(F.round("rrf", DIGITS).desc(), "key")
    pool = cut(fused.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= size).select("query", "key", "rrf", F.col("first_tier").alias("tier"), "at"))
    activation = None
    if plan.settle != "off":
        activation = _tried(plan, "settle", lambda: _activation(each, edges(), plan))
    if activation is not None:
        fresh = graphs.expansion(activation.filter("activation > 0"), each.select("query", F.col("key").alias("node")), plan.expansions)
        new = fresh.select("query", F.col("node").alias("key"), F.lit(0.0).alias("rrf"), F.lit(-1).alias("tier"), (F.lit(size) + F.col("place")).alias("at"))
        if texts is not None:
            new = new.join(texts.filter("text <> ''").select("key"), "key", "left_semi")
        pool = pool.unionByName(new.select(*pool.columns))
        pool = pool.join(activation.select("query", F.col("node").alias("key"), "activation"), ["query", "key"], "left")
    else:
        pool = pool.withColumn("activation", F.lit(None).cast("double"))
    pool = cut(pool)
    scored = None
    if rerank is not None:
        sent = pool.select("query", "key")
        sent = sent if texts is None else sent.join(texts.filter("text <> ''"), "key")
        scored = _tried(plan, "rerank", lambda: rerank(sent).groupBy("query", "key").agg(F.max("score").cast("double").alias("rerank")))
    pool = pool.withColumn("rerank", F.lit(None).cast("double")) if scored is None else pool.join(scored, ["query", "key"], "left")
    top = Window.partitionBy("query")  # a pool and its expansions
    tops = tuple(F.max(c).over(top) for c in ("rrf", "rerank", "activation"))
    active = plan.activation_weight if plan.settle == "channel" and activation is not None else 0.0
    score = ranking.fused(F.col("rrf"), F.col("rerank"), F.col("activation"), tuple(F.coalesce(t, F.lit(0.0)) for t in tops), plan.rerank_weight, active)
    last = Window.partitionBy("query").orderBy(F.desc("score"), "at")
    origin = F.when(F.col("tier") < 0, "expansion").otherwise(F.array(*map(F.lit, names))[F.greatest("tier", F.lit(0))])
    return pool.withColumn("score", F.round(score, DIGITS)).withColumn("place", F.row_number().over(last)).filter(F.col("place") <= plan.limit).select("query", "key", "score", "place", origin.alias("origin"))


def _activation(hits: DataFrame, edges: DataFrame, plan: Plan) -> DataFrame:
    seeds = cut(graphs.seed_mass(hits.select("query", "tier", F.col("key").alias("node"), "score")))
    return graphs.settle(graphs.neighbourhood(edges, seeds, plan.hops, plan.cap), seeds, plan.damping)
