"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Law ``rows``: the new shards' counts differ by one at most. A block is the rows of one old shard and one size class (sizes
within a factor of two); moving a row of it costs the block's mean bytes, staying costs nothing. The flow
from blocks to shards is solved on the driver over at most old shards x 64 blocks, a size that doesn't
depend on the rows, by successive cheapest paths. As a move's cost doesn't depend on where it ends,
all moves go through one node, which keeps the network small. The one row more that some shards take goes where it keeps the largest row from moving.

Within their block rows are ranked by size, largest first, and the first ranks stay; so what leaves an old shard are its smallest rows, and the moved
bytes are the fewest that any assignment of these counts can do with. Ranks come from counts by exact size and ``PARTS`` hash parts and a row number within
those, so that no task holds a whole block, and each arc of the flow takes a range of ranks. Slots of a shard are dealt to its arcs in turn, so
they are gapless from 0 without another sort. :func:`rewrite` writes only the shards that rows leave or enter, to a new folder: files of others aren't touched.

Null texts have no bytes, null ids are ids like others, repeated rows are rows of their own; rows with equal texts move like others, each for itself.
Ties of size go by a hash. Very long texts are rows like others. An empty table gives empty
shards. Rows whose old shard is null or negative lie in none (given back as null) and are placed like those of a shard
past the new count, which is emptied. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, PARTS = 24, 64
#: Old shard of rows that lie in none.
NOWHERE = (1 << 31) - 1


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest largest flow."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
    height = [0.0] * n
    while True:
        dist, last = [float("inf")] * n, [-1] * n
        dist[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x] + 1e-9:
                continue
            for e in graph[x]:
                if room[e] and (near := dist[x] + max(0.0, cost[e] + height[x] - height[to[e]])) < dist[to[e]] - 1e-9:
                    dist[to[e]], last[to[e]] = near, e
                    heapq.heappush(heap, (near, to[e]))
        if last[sink] < 0:
            return [capacity - room[2 * i] for i, (_, _, capacity, _) in enumerate(arcs)]
        height = [h + min(d, dist[sink]) for h, d in zip(height, dist, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(last[x])
            x = to[last[x] ^ 1]
        much = min(room[e] for e in path)
        for e in path:
            room[e] -= much
            room[e ^ 1] += much


def plan(blocks: list[tuple[int, int, int, int]], shards: int, saved: dict[int, int] | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """From blocks (old shard, class, rows, bytes) to moves (old shard, class, first rank, end rank, shard, first slot).

    ``saved`` has, for old shards that are over-full, the size of the row that needn't move if they take one row more.
    """
    total = sum(b[2] for b in blocks)
    capacity = [total // shards + (k < total % shards) for k in range(shards)]
    # nodes: source, sink, hub, blocks, shards
    counts = [0] * shards
    for old, _, n, _ in blocks:
        if old < shards:
            counts[old] += n
    order = sorted(range(shards), key=lambda k: (-(saved or {}).get(k, 0), -counts[k], k))
    capacity = [capacity[order.index(k)] for k in range(shards)]
    at = lambda i: 3 + i
    shard = lambda k: 3 + len(blocks) + k
    arcs, stay, leave = [], {}, {}
    for i, (old, _, n, size) in enumerate(blocks):
        arcs.append((0, at(i), n, 0.0))
        if old < shards:
            stay[i] = len(arcs)
            arcs.append((at(i), shard(old), n, 0.0))
        leave[i] = len(arcs)
        arcs.append((at(i), 2, n, size / max(n, 1)))
    enter = {}
    for k in range(shards):
        enter[k] = len(arcs)
        arcs.append((2, shard(k), capacity[k], 0.0))
        arcs.append((shard(k), 1, capacity[k], 0.0))
    flow = min_cost_flow(3 + len(blocks) + shards, arcs, 0, 1)
    moves, slot = [], [0] * shards
    wanted = [[k, flow[enter[k]]] for k in range(shards) if flow[enter[k]]]
    for i, (old, kind, n, _) in enumerate(blocks):
        done = flow[stay[i]] if i in stay else 0
        if done:
            moves.append((old, kind, 0, done, old, slot[old]))
            slot[old] += done
        left = flow[leave[i]]
        while left:
            k, room = wanted[-1]
            take = min(left, room)
            moves.append((old, kind, done, done + take, k, slot[k]))
            slot[k] += take
            done, left, wanted[-1][1] = done + take, left - take, room - take
            if not wanted[-1][1]:
                wanted.pop()
    return moves


def _solved(docs: DataFrame, old_shard: str, doc_id: str, text: str, shards: int) -> tuple[DataFrame, list[tuple]]:
    """The rows as ``doc_id, text, old_shard, shard, slot``, and the moves."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.when(F.col(old_shard) >= 0, F.col(old_shard)), F.lit(NOWHERE)).cast("int").alias("old_shard"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = rows.withColumns({"size": size, "kind": F.floor(F.log2(size)).cast("int"), "part": F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)).cast("int")})
    by = ["old_shard", "kind", "size", "part"]
    parts = cut(rows.groupBy(*by).agg(F.count("*").alias("n")), "parts")
    blocks = [tuple(r) for r in parts.groupBy("old_shard", "kind").agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).orderBy("old_shard", "kind").collect()]  # old shards x 64 at most
    least = sum(b[2] for b in blocks) // shards
    sizes = parts.groupBy("old_shard", "size").agg(F.sum("n").alias("n"))  # a row a size: windows over them don't grow with the rows
    upto = F.sum("n").over(Window.partitionBy("old_shard").orderBy("size"))
    full = F.sum("n").over(Window.partitionBy("old_shard"))
    saved = sizes.withColumns({"upto": upto, "full": full}).filter((F.col("old_shard") < shards) & (F.col("full") > least) & (F.col("upto") >= F.col("full") - least)).groupBy("old_shard").agg(F.min("size")).collect()
    moves = plan(blocks, shards, {r[0]: r[1] for r in saved})
    # ranks before a size within the block, then before a hash part within the size: neither window has more than a row a size or a part
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    larger = parts.groupBy(*by[:3]).agg(F.sum("n").alias("n")).select(*by[:3], before(Window.partitionBy(*by[:2]).orderBy(F.desc("size"))).alias("larger"))
    base = parts.withColumn("own", before(Window.partitionBy(*by[:3]).orderBy("part"))).join(larger, by[:3]).select(*by, (F.col("larger") + F.col("own")).alias("base"))
    dealt = spark.createDataFrame(moves, "old_shard int, kind int, lo long, hi long, shard int, slot0 long")
    own = Window.partitionBy(*by).orderBy("doc_id", F.xxhash64("text"))
    ranked = rows.withColumn("nth", F.row_number().over(own) - 1).join(base, by).withColumn("rank", F.col("base") + F.col("nth"))
    out = ranked.join(F.broadcast(dealt) if len(moves) <= 100_000 else dealt, ["old_shard", "kind"]).filter("rank >= lo AND rank < hi")
    return out.select("doc_id", "text", F.nullif("old_shard", F.lit(NOWHERE)).alias("old_shard"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot")), moves


def assign(docs: DataFrame, old_shard: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """The rows as ``doc_id, text, old_shard, shard, slot``."""
    return _solved(docs, old_shard, doc_id, text, shards)[0]


def rewrite(docs: DataFrame, old_shard: str, path: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> tuple[DataFrame, list[int]]:
    """Moves the rows: the shards that rows leave or enter are written as ``path/shard=k``, the others stay where ``docs`` has them.

    Returns all rows as :func:`assign` gives them, read from where they lie now, and the shards written. ``path`` must be new:
    readers of the old files see them whole until they switch over, and a failed job leaves nothing changed.
    """
    out, moves = _solved(docs, old_shard, doc_id, text, shards)
    changed = sorted({k for old, _, _, _, shard, _ in moves if old != shard for k in (old, shard) if k < shards})
    out.filter(F.col("shard").isin(changed)).write.partitionBy("shard").parquet(path)
    moved = docs.sparkSession.read.schema(out.schema).parquet(path).select(out.columns)
    return (moved if len(changed) == shards else moved.unionByName(out.filter(~F.col("shard").isin(changed)))), changed
