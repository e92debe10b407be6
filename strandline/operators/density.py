"""Density clustering of vectors (HDBSCAN with excess of mass), by cosine distance, one hierarchy a space.

Every step is a job over all spaces at once, and none holds a space:

1. equal vectors become one node with a count, so groups of copies cost as much as one vector;
2. nodes are dealt into blocks of at most some thousand rows, and each pair of blocks of a space is a task's work: a matrix of distances, of which only the nearest of each
   node leave the task;
3. the minimum spanning tree of mutual reachability is grown in Boruvka rounds of joins. A component takes its lightest edge among the known nearest;
   nodes whose unknown edges could be lighter (their bound says so) are searched exactly, in blocks again, and remember what was found;
4. the tree's edges are merged by rising weight in levels of a bounded number of edges. What a component was before is one row: its size, its open cluster and sums.

Edges of equal weight merge at once. So the result doesn't depend on their order; libraries that merge one edge after another can differ there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .lineage import cut
from .search import matrices

#: Distances are compared to so many digits.
DIGITS = 12
#: Components of a block of nodes: rows times length of vectors; and rows at most.
BLOCK_CELLS, BLOCK_ROWS = 1 << 17, 2048
#: Edges of a space that one level merges, about.
LEVEL_EDGES = 50_000


def _nodes(vectors: DataFrame, by: str, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``space, id, copies, vec, block, blocks`` and ``space, id, node`` of every usable row."""
    rows = vectors.select(F.col(by).alias("space"), F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.filter("space IS NOT NULL AND id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    same = rows.groupBy("space", "vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    same = cut(same)
    # equal vectors are joined by their hash and themselves
    member = rows.join(same.withColumnRenamed("copies", "_n"), ["space", "vec"]).select("space", "id", "node").distinct()
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_CELLS) / F.max(F.size("vec")))))
    sizes = same.groupBy("space").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"), F.sum("copies").alias("total"))
    nodes = same.join(sizes, "space").select("space", F.col("node").alias("id"), "copies", "total", "vec", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    return cut(nodes), cut(member)


def _pairs(rows: DataFrame) -> DataFrame:
    """Every row once for each pair of blocks that its own is part of, as ``one, other`` (one <= other)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    both = rows.select("*", other)
    return both.withColumn("one", F.least("block", "other")).withColumn("other", F.greatest("block", "other"))


def _distances(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """1 - cosine, held to 0 to 2; vectors without a direction or of another length are at distance 1."""
    out, left, right = np.ones((len(a), len(b))), matrices(a), matrices(b)
    for size, (unit, at) in left.items():
        if size in right:
            d = unit @ right[size][0].T
            np.clip(np.subtract(1, d, out=d), 0, 2, out=d)
            if d.shape == out.shape:
                out = d
            else:
                out[np.ix_(at, right[size][1])] = d
    return np.round(out, DIGITS, out=out)


def _sides(table: pa.Table):
    """Both directions of a pair of blocks: (rows of one, rows of the other, whether they are the same block)."""
    block, one, other = table.column("block").to_numpy(), table.column("one")[0].as_py(), table.column("other")[0].as_py()
    a, b = (table.filter(pa.array(block == x)) for x in (one, other))
    return [(a, b, True)] if one == other else [(a, b, False), (b, a, False)]


def _nearest(nodes: DataFrame, k: int, least: int) -> DataFrame:
    """``space, id, other, d, copies``: each node's k nearest others, or more where fewer than ``least`` rows stand among them (which k >= least rules out)."""
    kinds = {f.name: (f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in nodes.schema}

    def best(table: pa.Table) -> pa.Table:
        parts = []
        for a, b, own in _sides(table):
            if not a.num_rows or not b.num_rows:
                continue
            d = _distances(a.column("vec"), b.column("vec"))
            if own:
                np.fill_diagonal(d, np.inf)
            many = min(k, b.num_rows)
            at = np.argpartition(d, many - 1, axis=1)[:, :many] if many < b.num_rows else np.tile(np.arange(many), (len(d), 1))
            row, col = np.repeat(np.arange(len(d)), many), at.ravel()
            keep = np.isfinite(d[row, col])
            row, col = row[keep], col[keep]
            parts.append(pa.table({"space": a.column("space").take(pa.array(row)), "id": a.column("id").take(pa.array(row)), "other": b.column("id").take(pa.array(col)), "d": pa.array(d[row, col]), "copies": b.column("copies").take(pa.array(col))}))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in [("space", kinds["space"][1]), ("id", kinds["id"][1]), ("other", kinds["id"][1]), ("d", pa.float64()), ("copies", pa.int64())]})

    found = _pairs(nodes.select("space", "id", "copies", "vec", "block", "blocks")).groupBy("space", "one", "other").applyInArrow(best, f"space {kinds['space'][0]}, id {kinds['id'][0]}, other {kinds['id'][0]}, d double, copies long")
    order = Window.partitionBy("space", "id").orderBy("d", "other")  # k rows of each block
    return cut(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n"))


def _searched(nodes: DataFrame, comps: DataFrame, open_: DataFrame) -> DataFrame:
    """``space, id, other, w``: of each open node (``space, id``), the lightest edge of mutual reachability that leaves its component, by exact search."""
    kinds = {f.name: (f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in nodes.schema}
    rows = nodes.join(open_.select("space").distinct(), "space", "left_semi").join(comps, ["space", "id"]).join(open_.select("space", "id", F.lit(True).alias("open")), ["space", "id"], "left")

    def best(table: pa.Table) -> pa.Table:
        parts = []
        for a, b, _ in _sides(table):
            a = a.filter(a.column("open").fill_null(False)).sort_by("id")
            if not a.num_rows or not b.num_rows:
                continue
            b = b.sort_by("id")
            w = _distances(a.column("vec"), b.column("vec"))
            np.maximum(w, a.column("core").to_numpy()[:, None], out=w)
            np.maximum(w, b.column("core").to_numpy(), out=w)
            comps = pa.chunked_array([*a.column("comp").chunks, *b.column("comp").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            w[comps[: len(w), None] == comps[len(w) :]] = np.inf
            at = w.argmin(axis=1)  # of equal ones the least id
            keep = np.flatnonzero(np.isfinite(w[np.arange(len(w)), at]))
            parts.append(pa.table({"space": a.column("space").take(pa.array(keep)), "id": a.column("id").take(pa.array(keep)), "other": b.column("id").take(pa.array(at[keep])), "w": pa.array(w[keep, at[keep]])}))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in [("space", kinds["space"][1]), ("id", kinds["id"][1]), ("other", kinds["id"][1]), ("w", pa.float64())]})

    found = _pairs(rows.select("space", "id", "vec", "block", "blocks", "comp", "core", "open")).groupBy("space", "one", "other").applyInArrow(best, f"space {kinds['space'][0]}, id {kinds['id'][0]}, other {kinds['id'][0]}, w double")
    return cut(found.groupBy("space", "id").agg(F.min(F.struct("w", "other")).alias("b")).select("space", "id", "b.other", "b.w"))


def _roots(chosen: DataFrame) -> DataFrame:
    """``space, comp, root``: components along their chosen ones (``space, comp, to``); of two that chose each other the lesser is the root."""
    back = chosen.select("space", F.col("comp").alias("to"), F.col("to").alias("back"))
    up = chosen.join(back, ["space", "to"], "left").select("space", "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
    up = cut(up)
    for _ in range(64):  # steps double
        above = up.select("space", F.col("comp").alias("root"), F.col("root").alias("above"))
        step = cut(up.join(above, ["space", "root"]).select("space", "comp", "root", "above"))
        up = step.select("space", "comp", F.col("above").alias("root"))
        if step.filter("root <> above").isEmpty():
            return up
    raise RuntimeError("components that chose each other in a ring")


def spanning_tree(nodes: DataFrame, min_samples: int, near: int) -> tuple[DataFrame, DataFrame]:
    """``space, a, b, w`` of the minimum spanning tree of mutual reachability (edges of a space that ties make double are harmless), and ``space, id, core``.

    ``core`` is the distance within which ``min_samples`` other rows lie, copies counted.
    """
    k = max(near, min_samples)
    known = _nearest(nodes, k, min_samples)
    upto = F.sum("copies").over(Window.partitionBy("space", "id").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, 0))
    needed = F.least(F.lit(min_samples), F.col("total") - 1) - (F.col("copies") - 1)
    reach = known.withColumn("upto", upto).select("space", "id", "d", "upto")
    inner = nodes.select("space", "id", needed.alias("needed"), (F.col("total") > 1).alias("some"))
    core = inner.join(reach, ["space", "id"], "left").groupBy("space", "id").agg(F.coalesce(F.when(F.first("needed") > 0, F.min(F.when(F.col("upto") >= F.col("needed"), F.col("d")))), F.lit(0.0)).alias("core"))
    core = cut(core)
    last = known.groupBy("space", "id").agg(F.max("d").alias("last"), F.count("*").alias("n"))
    counts = nodes.groupBy("space").agg(F.count("*").alias("nodes"))
    # a node that knows all others has no unknown edge
    bound = core.join(last, ["space", "id"]).join(counts, "space").select("space", "id", F.when(F.col("n") >= F.col("nodes") - 1, F.lit(float("inf"))).otherwise(F.greatest("core", "last")).alias("bound"))
    ends = core.select("space", F.col("id").alias("other"), F.col("core").alias("core_other"))
    edges = cut(known.join(core, ["space", "id"]).join(ends, ["space", "other"]).select("space", "id", "other", F.greatest("core", "core_other", "d").alias("w")))
    comps, bound, tree = cut(core.select("space", "id", F.col("id").alias("comp"), "core")), cut(bound), None
    while True:
        here, there = comps.select("space", "id", "comp"), comps.select("space", F.col("id").alias("other"), F.col("comp").alias("to"))
        leaving = cut(edges.join(here, ["space", "id"]).join(there, ["space", "other"]).filter("comp <> to"))
        rank = F.struct("w", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "to")
        best = leaving.groupBy("space", "comp").agg(F.min("w").alias("best"))
        several = comps.groupBy("space").agg((F.min("comp") != F.max("comp")).alias("several")).filter("several").select("space")
        if several.isEmpty():
            break
        could = bound.join(here, ["space", "id"]).join(several, "space", "left_semi").join(best, ["space", "comp"], "left").filter("best IS NULL OR bound <= best").filter("bound < double('inf')")
        open_ = cut(could.select("space", "id"))
        if not open_.isEmpty():
            found = _searched(nodes, comps, open_)
            new = found.join(here, ["space", "id"]).join(there, ["space", "other"]).select("space", "other", "id", "w", "comp", "to")
            leaving = leaving.unionByName(new)
            bound = cut(bound.join(found.select("space", "id", F.col("w").alias("seen")), ["space", "id"], "left").select("space", "id", F.coalesce("seen", "bound").alias("bound")))
        chosen = cut(leaving.groupBy("space", "comp").agg(F.min(rank).alias("e")).select("space", "comp", "e.a", "e.b", "e.w", "e.to"))
        tree = chosen.select("space", "a", "b", "w") if tree is None else tree.unionByName(chosen.select("space", "a", "b", "w"))
        # edges within a component are of no more use
        edges = cut(leaving.select("space", "id", "other", "w").distinct())
        comps = cut(comps.join(_roots(chosen.select("space", "comp", "to")), ["space", "comp"], "left").select("space", "id", F.coalesce("root", "comp").alias("comp"), "core"))
    none = comps.limit(0).select("space", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    return cut(none if tree is None else tree.distinct()), core


def _merge(level: int, least: int, edges: list[dict], states: list[dict]) -> list[dict]:
    """Components after a level's edges, and what happened: nodes that joined a cluster, clusters that closed.

    A state: ``comp``, ``n`` rows, ``raw`` (copies not yet together), ``ids`` of its nodes while it is too small for a cluster, its open ``cluster`` with ``s`` (the
    sum over rows of the inverse distance at which they left), and ``score``, the best total stability below it.
    """
    state = {r["comp"]: dict(r) for r in states}
    for e in edges:
        for c in (e["a"], e["b"]):
            state.setdefault(c, {"comp": c, "n": 1, "raw": False, "ids": [c], "cluster": None, "s": 0.0, "score": 0.0})
    parent = {c: c for c in state}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, made, edges, lo = [], 0, sorted(edges, key=lambda e: e["w"]), 0
    while lo < len(edges):
        hi = lo
        while hi < len(edges) and edges[hi]["w"] == edges[lo]["w"]:
            hi += 1
        at = 1 / edges[lo]["w"] if edges[lo]["w"] > 0 else float("inf")
        was = {find(c) for e in edges[lo:hi] for c in (e["a"], e["b"])}
        for e in edges[lo:hi]:
            a, b = sorted((find(e["a"]), find(e["b"])))
            parent[b] = a
        groups: dict = {}
        for c in was:
            groups.setdefault(find(c), []).append(state[c])
        for root, parts in groups.items():
            if len(parts) == 1 and not parts[0]["raw"]:
                continue
            big = [p for p in parts if p["cluster"] is not None]
            small = [p for p in parts if p["cluster"] is None]
            n, ids = sum(p["n"] for p in parts), [i for p in small for i in p["ids"]]
            rest = sum(p["n"] for p in small)
            new = {"comp": root, "n": n, "raw": False, "ids": [], "cluster": None, "s": 0.0, "score": 0.0}
            if len(big) == 1:
                new |= {"cluster": big[0]["cluster"], "s": big[0]["s"] + (rest * at if rest else 0.0), "score": big[0]["score"]}
            elif n >= least:
                new |= {"cluster": level << 32 | made, "s": n * at}
                made += 1
                for p in big:
                    stable = p["s"] - p["n"] * at
                    new["score"] += max(stable, p["score"])
                    out.append({"kind": "closed", "cluster": p["cluster"], "parent": new["cluster"], "selected": stable >= p["score"]})
            else:
                new["ids"] = ids
            if new["cluster"] is not None:
                out += [{"kind": "joined", "comp": i, "cluster": new["cluster"]} for i in ids]
            for p in parts:
                state.pop(p["comp"], None)
            state[root] = new
        lo = hi
    out += [{"kind": "merged", "comp": c, "root": find(c)} for c in parent if find(c) != c]
    return out + [{"kind": "state", **s} for s in state.values()]


def _hierarchy(nodes: DataFrame, tree: DataFrame, core: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``space, id, cluster`` of nodes that belong to one, and ``space, cluster, parent, selected`` of all clusters but the roots."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    copies = nodes.filter("copies > 1").select("space", "id", "copies")
    own = copies.join(core, ["space", "id"]).select("space", F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("w"))
    edges = cut(tree.unionByName(own))
    many = edges.groupBy("space").agg(F.ceil(F.count("*") / LEVEL_EDGES).cast("int").alias("levels"))
    most = many.agg(F.max("levels")).head()[0] or 0
    if most > 1:
        cuts = edges.groupBy("space").agg(F.percentile_approx("w", [i / most for i in range(1, most + 1)], F.lit(10 * most)).alias("cuts"))
        edges = cut(edges.join(cuts, "space").withColumn("level", F.size(F.filter("cuts", lambda c: c < F.col("w")))).drop("cuts"))
    else:
        edges = edges.withColumn("level", F.lit(0))
    states = copies.select("space", F.col("id").alias("comp"), F.col("copies").alias("n"), F.lit(True).alias("raw"), F.array("id").alias("ids"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("s"), F.lit(0.0).alias("score"))
    schema = f"space {kinds['space']}, kind string, comp {kinds['id']}, root {kinds['id']}, n long, raw boolean, ids array<{kinds['id']}>, cluster long, parent long, s double, score double, selected boolean"
    out = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)
    joined = closed = None
    for level in range(most + 1):
        now = edges.filter(F.col("level") == level)
        touched = now.select("space", F.explode(F.array("a", "b")).alias("comp")).distinct()

        def merge(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, space = _merge(level, least, left.to_pylist(), right.to_pylist()), left.column("space")[0].as_py()
            return pa.Table.from_pylist([{"space": space, **r} for r in rows], out)

        fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
        some = fresh(states.join(touched, ["space", "comp"], "left_semi"))
        done = cut(fresh(now.select("space", "a", "b", "w")).groupBy("space").cogroup(some.groupBy("space")).applyInArrow(merge, schema))
        joined_now, closed_now = done.filter("kind = 'joined'").select("space", F.col("comp").alias("id"), "cluster"), done.filter("kind = 'closed'").select("space", "cluster", "parent", "selected")
        joined, closed = (joined_now, closed_now) if joined is None else (joined.unionByName(joined_now), closed.unionByName(closed_now))
        if level < most:
            merged = done.filter("kind = 'merged'").select("space", "comp", "root")
            rest = edges.filter(F.col("level") > level)
            for end in ("a", "b"):
                rest = rest.join(merged.select("space", F.col("comp").alias(end), "root"), ["space", end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
            edges = cut(rest)
            states = cut(states.join(touched, ["space", "comp"], "left_anti").unionByName(done.filter("kind = 'state'").select(*states.columns)))
    return cut(joined), cut(closed)


def clusters(vectors: DataFrame, by: str, key: str, vec: str = "embedding", min_size: int = 3, min_samples: int | None = None, near: int = 16) -> DataFrame:
    """``by, key, cluster``: the cluster of every row of a space, named by its least key; null for noise.

    A cluster has ``min_size`` rows at least (2 or more), and a space's whole hierarchy is never one cluster: one dense blob is noise. ``near`` is how many neighbours are
    known before a search; it changes the time, not the result. Rows with a null space or key are left out, those with a null, empty or non-finite vector are noise. Rows that share
    a key are one where their vectors are equal too; zero vectors, and vectors of different lengths, lie at distance 1 from others.
    """
    if min_size < 2:
        raise ValueError("a cluster has 2 rows or more")
    nodes, member = _nodes(vectors, by, key, vec)
    tree, core = spanning_tree(nodes, min_samples or min_size, near)
    joined, closed = _hierarchy(nodes, tree, core, min_size)
    # a selected cluster holds all below it: the topmost selected one counts
    top = cut(closed.select("space", "cluster", "parent", F.when(F.col("selected"), F.col("cluster")).alias("name")))
    while True:  # each round looks twice as far up
        above = top.select("space", F.col("cluster").alias("parent"), F.col("parent").alias("next"), F.col("name").alias("higher"))
        step = cut(top.join(above, ["space", "parent"], "left").select("space", "cluster", F.col("next").alias("parent"), F.coalesce("higher", "name").alias("name")))
        top = step
        if step.filter("parent IS NOT NULL").isEmpty():
            break
    named = member.join(joined.withColumnRenamed("id", "node"), ["space", "node"]).join(top.select("space", "cluster", "name"), ["space", "cluster"]).filter("name IS NOT NULL").select("space", "id", "name")
    first = named.groupBy("space", "name").agg(F.min("id").alias("cluster"))
    found = named.join(first, ["space", "name"]).select(F.col("space").alias(by), F.col("id").alias(key), "cluster")
    every = vectors.select(by, key).filter(F.col(by).isNotNull() & F.col(key).isNotNull()).distinct()
    return every.join(found, [by, key], "left")
