"""Co-activation graphs: pairs, weights, boosts and spreading activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import association_weight

from .lineage import cut


#: Items whose pairs a task makes, about.
TASK_ITEMS = 1 << 19


def pairs(items: DataFrame, batch: str, item: str, position: str) -> DataFrame:
    """Ordered pairs of different items within a batch, as src and dst; a batch is bounded by what is ingested at once.

    Where shuffles have too few tasks for the items, they are dealt over more: a task has about ``TASK_ITEMS``, however many there are.
    """
    tasks = -(-items.count() // TASK_ITEMS)
    if tasks > int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        items = items.repartition(tasks, batch)
    a, b = items.alias("a"), items.alias("b")
    on = (F.col(f"a.{batch}") == F.col(f"b.{batch}")) & (F.col(f"a.{position}") < F.col(f"b.{position}"))
    return a.join(b, on).filter(F.col(f"a.{item}") != F.col(f"b.{item}")).select(F.col(f"a.{item}").alias("src"), F.col(f"b.{item}").alias("dst"))


def added(new: DataFrame, known: DataFrame) -> DataFrame:
    """``src, dst, n`` of new pairs, a row each, and known counts, to be summed in one grouping."""
    return new.select("src", "dst", F.lit(1).cast("long").alias("n")).unionByName(known.select("src", "dst", "n"))


def fold(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``src, dst, n, weight`` of new pairs added to known counts."""
    counts = new.groupBy("src", "dst").agg(F.count("*").alias("n")) if known is None else added(new, known).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return counts.withColumn("weight", association_weight(F.col("n")))


def boosts(edges: DataFrame, candidates: DataFrame, key: str = "key") -> DataFrame:
    """Sum of weights from each candidate to other candidates; 0 where there are none."""
    inside = edges.join(candidates.select(F.col(key).alias("dst")), "dst", "left_semi")
    sums = inside.groupBy(F.col("src").alias(key)).agg(F.sum("weight").alias("boost"))
    return candidates.select(key).join(sums, key, "left").select(key, F.coalesce("boost", F.lit(0.0)).alias("boost"))


def incident(edges: DataFrame, nodes: DataFrame, end: str = "src", node: str = "node") -> DataFrame:
    """Edges that have a node at the given end."""
    return edges.join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: ``node, other, weight, direction``."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight", F.lit("in").alias("direction")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, cap: int = 2000) -> DataFrame:
    """``query, src, dst, weight``: the graph around the seeds (``query, node``) of each query, weights divided by max(sum of a node's, 1).

    Nodes are taken hop by hop, heaviest edge first (ties: the smaller node), up to ``cap`` for each query. An edge's weight counts once
    for each hop that reaches it from a node of the hop before; both directions are added.
    """
    if hops < 0 or cap < 1:
        raise ValueError("hops is 0 or more, cap 1 or more")
    edges = cut(edges.select("src", "dst", "weight"))
    way = both_ways(edges).filter("node <> other")
    nodes = seeds.select("query", "node").distinct().withColumn("hop", F.lit(0))
    for hop in range(hops):
        known = nodes.select("query", F.col("node").alias("other"))
        room = nodes.groupBy("query").agg((F.lit(cap) - F.count("*")).alias("room")).filter("room > 0")  # full queries go no further
        found = nodes.filter(F.col("hop") == hop).join(room, "query").join(way, "node").join(known, ["query", "other"], "left_anti")
        found = found.groupBy("query", "room", "other").agg(F.max("weight").alias("weight"))
        order = Window.partitionBy("query").orderBy(F.desc("weight"), "other")
        new = found.withColumn("place", F.row_number().over(order)).filter("place <= room")
        nodes = cut(nodes.unionByName(new.select("query", F.col("other").alias("node"), F.lit(hop + 1).alias("hop"))))
    a = nodes.select("query", F.col("node").alias("src"), F.col("hop").alias("h1"))
    b = nodes.select("query", F.col("node").alias("dst"), F.col("hop").alias("h2"))
    reach = lambda h: (F.col(h) < hops).cast("int")
    times = reach("h1") + reach("h2") - (F.col("h1") == F.col("h2")).cast("int") * reach("h1")
    inside = edges.filter("src <> dst").join(a, "src").join(b, ["query", "dst"]).withColumn("weight", F.col("weight") * times)
    raw = inside.select("query", "src", "dst", "weight").unionByName(inside.select("query", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("query", "src", "dst").agg(F.sum("weight").alias("weight"))
    total = raw.groupBy("query", "src").agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("total"))
    return raw.join(total, ["query", "src"]).select("query", "src", "dst", (F.col("weight") / F.col("total")).alias("weight"))


def settle(graph: DataFrame, seeds: DataFrame, damping: float = 0.7, eps: float = 1e-6, rounds: int = 20) -> DataFrame:
    """Activation ``query, node, activation``: (1 - damping) x seed + damping x what neighbours send, until it moves by less than ``eps``
    in all, or for ``rounds`` rounds. One task a query; a neighbourhood's node cap bounds it."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    if not 0 <= damping < 1 or eps <= 0 or rounds < 1:
        raise ValueError("damping is 0 or more and under 1, eps above 0, rounds 1 or more")
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema}
    arrow = {c: to_arrow_type(seeds.schema[c].dataType) for c in ("query", "node")}

    def one(key: tuple, edges: pa.Table, own: pa.Table) -> pa.Table:
        ends = [t.column(c).to_numpy() for t, c in ((own, "node"), (edges, "src"), (edges, "dst"))]
        names, at = np.unique(np.concatenate(ends), return_inverse=True)
        first, src, dst = np.split(at, np.cumsum([len(ends[0]), len(ends[1])]))
        weight, seed = edges.column("weight").to_numpy(), np.bincount(first, own.column("mass").to_numpy(), len(names))
        now = seed
        for _ in range(rounds):
            then = (1 - damping) * seed + damping * np.bincount(dst, now[src] * weight, len(names))
            moved, now = np.abs(then - now).sum(), then
            if moved < eps:
                break
        return pa.table({"query": pa.array([key[0].as_py()] * len(names), arrow["query"]), "node": pa.array(names.tolist(), arrow["node"]), "activation": pa.array(now)})

    # both come from the seeds: new columns tell them apart
    fresh = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))
    left, right = fresh(graph, "query", "src", "dst", "weight"), fresh(seeds, "query", "node", "mass")
    return left.groupBy("query").cogroup(right.groupBy("query")).applyInArrow(one, f"query {kinds['query']}, node {kinds['node']}, activation double")


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, damping: float = 0.7, eps: float = 1e-6, rounds: int = 20, most: int | None = None, digits: int = 8) -> DataFrame:
    """``query, node, activation`` as :func:`settle` finds it over the :func:`neighbourhood` of all nodes within ``hops`` of the seeds (``query, node, mass``), without a cap.

    An edge between two nodes of the last hop carries nothing, so a query needs the edges of the nodes before them only: their number is what its task holds. With ``most``
    come only nodes that are no seeds and can be among that many best once activations are rounded to ``digits``.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    if hops < 0 or not 0 <= damping < 1 or eps <= 0 or rounds < 1:
        raise ValueError("hops is 0 or more, damping 0 or more and under 1, eps above 0, rounds 1 or more")
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema}
    arrow = {c: to_arrow_type(seeds.schema[c].dataType) for c in ("query", "node")}
    way = cut(both_ways(edges).filter("node <> other").groupBy("node", "other").agg(F.sum("weight").alias("weight")))
    near = seeds.select("query", "node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops):
        found = near.filter(F.col("hop") == hop - 1).join(way, "node").select("query", F.col("other").alias("node")).distinct()
        near = cut(near.unionByName(found.join(near, ["query", "node"], "left_anti").withColumn("hop", F.lit(hop))))
    links = near.filter(F.col("hop") < hops).join(way, "node")

    def one(key: tuple, links: pa.Table, own: pa.Table) -> pa.Table:
        ends = [t.column(c).to_numpy() for t, c in ((own, "node"), (links, "node"), (links, "other"))]
        names, at = np.unique(np.concatenate(ends), return_inverse=True)
        first, src, dst = np.split(at, np.cumsum([len(ends[0]), len(ends[1])]))
        hop = np.full(len(names), hops)
        hop[first], hop[src] = 0, links.column("hop").to_numpy()
        weight, far = links.column("weight").to_numpy() * (1 + (hop[dst] < hops) - (hop[src] == hop[dst])), hop[dst] == hops
        src, dst, weight = np.concatenate([src, dst[far]]), np.concatenate([dst, src[far]]), np.concatenate([weight, weight[far]])
        weight /= np.maximum(np.bincount(src, weight, len(names)), 1.0)[src]
        now = seed = np.bincount(first, own.column("mass").to_numpy(), len(names))
        for _ in range(rounds):
            then = (1 - damping) * seed + damping * np.bincount(dst, now[src] * weight, len(names))
            moved, now = np.abs(then - now).sum(), then
            if moved < eps:
                break
        kept = np.arange(len(names))
        if most is not None:
            kept = kept[hop > 0]
            if len(kept) > most:
                kept = kept[now[kept] >= np.partition(now[kept], -most)[-most] - 2 * 0.1**digits]
        return pa.table({"query": pa.array([key[0].as_py()] * len(kept), arrow["query"]), "node": pa.array(names[kept].tolist(), arrow["node"]), "activation": pa.array(now[kept])})

    fresh = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))  # noqa: E731  both come from the seeds
    left, right = fresh(links, "query", "node", "other", "weight", "hop"), fresh(seeds, "query", "node", "mass")
    return left.groupBy("query").cogroup(right.groupBy("query")).applyInArrow(one, f"query {kinds['query']}, node {kinds['node']}, activation double")


def expansion(activation: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """The ``most`` nodes of the highest activation of each query that are no seeds, with their ``place``."""
    order = Window.partitionBy("query").orderBy(F.desc("activation"), "node")
    rest = activation.join(seeds.select("query", "node").distinct(), ["query", "node"], "left_anti")
    return rest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def seed_mass(hits: DataFrame) -> DataFrame:
    """``query, node, mass`` of hits (``query, tier, node, score``): scores over their tier's largest, the mean over tiers, shares of the whole.

    Tiers without a positive score add nothing, but their hits count as tiers of a node.
    """
    top = hits.groupBy("query", "tier").agg(F.max("score").alias("top"))
    each = hits.join(top, ["query", "tier"]).groupBy("query", "node").agg((F.sum(F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)) / F.count("*")).alias("raw"))
    total = each.groupBy("query").agg(F.sum("raw").alias("total"))
    return each.join(total, "query").filter("total > 0").select("query", "node", (F.col("raw") / F.col("total")).alias("mass"))


def decayed(edges: DataFrame, days: str, factor: float = 0.999, least: float = 0.001) -> DataFrame:
    """Edges whose last use is more than a day back lose a part of their weight; those that get under ``least`` go."""
    weight = F.when(F.col(days) > 1, F.col("weight") * factor).otherwise(F.col("weight"))
    return edges.withColumn("weight", weight).filter(F.col("weight") >= least)


#: What an association of a type adds to a boost.
TYPE_SIGNS = {"hebbian": 1.0, "supports": 0.5, "contradicts": -0.5}


def typed_boosts(edges: DataFrame, kind: str = "kind") -> DataFrame:
    """``node, boost``: the signed weights of a node's edges in either direction; other types add nothing."""
    sign = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_SIGNS.items() for x in pair]), F.col(kind)), F.lit(0.0))
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), (F.col("weight") * sign).alias("w")).groupBy("node").agg(F.sum("w").alias("boost"))
