"""Memories that may contradict each other, and what it does to them when one is confirmed, supported or superseded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars

from . import search
from .lineage import cut

#: Evidence that a confirmed contradiction and a support give.
AGAINST, FOR = 0.10, 0.65


def candidates(memories: DataFrame, new: DataFrame, least: float = 0.85, most: int = 50) -> DataFrame:
    """``a, b, similarity``: for each memory named in ``new`` (``id``), of its ``most`` nearest active ones of the same space those of ``least`` similarity or more and other content.

    ``memories`` are ``id, space, state, content, vec``. A memory isn't its own candidate; one without a usable vector has none, and ids that are in no row are passed over. Two null contents
    are equal. Of several rows of one id the one of the least hash speaks. Searched in blocks of queries: each task keeps its best for each, and no space is one task's.
    """
    named = ["id", "space", "state", "content", "vec"]
    rows = memories.select(*named).filter("id IS NOT NULL AND space IS NOT NULL")
    rows = cut(rows.groupBy("id").agg(F.min_by(F.struct(*named[1:]), F.xxhash64(*named)).alias("r")).select("id", "r.*"))
    asked = cut(rows.join(new.select("id").distinct(), "id", "left_semi"))
    kind = asked.schema["id"].dataType
    scan = rows.filter("state = 'active'").select("space", F.col("id").alias("key"), "vec")
    spark = rows.sparkSession

    def one(block: pa.Table) -> DataFrame | None:
        spaces = sorted({r for r in block.column("vec").combine_chunks().field("space").to_pylist()})
        cells = spark.createDataFrame([(s, i) for i, s in enumerate(spaces)], f"space {rows.schema['space'].dataType.simpleString()}, cell long")
        own, targets = {s: i for i, s in enumerate(spaces)}, {}
        cell = pa.array([own[s] for s in block.column("vec").combine_chunks().field("space").to_pylist()])
        for i in range(len(spaces)):
            part = pa.table({"query": block.column("query"), "vec": block.column("vec").combine_chunks().field("vec")}).filter(pa.compute.equal(cell, i))
            for size, (unit, at) in search.matrices(part.column("vec")).items():
                targets[i, size] = [part.column("query")[int(x)].as_py() for x in at], unit
        # a block's spaces are at most as many as its queries
        return search.best_rows(scan.join(F.broadcast(cells), "space"), targets, most + 1, kind) if targets else None

    queries = asked.select(F.col("id").alias("query"), F.struct("space", "vec").alias("vec"))
    found = search.in_blocks(queries, one, search.nothing(scan, queries)).filter("query <> key")
    near = search.top(found, most).filter(F.col("score") >= least).select(F.col("query").alias("a"), F.col("key").alias("b"), F.col("score").alias("similarity"))
    near = near.join(asked.select(F.col("id").alias("a"), F.col("content").alias("one")), "a").join(rows.select(F.col("id").alias("b"), F.col("content").alias("other")), "b")
    return near.filter(~F.col("one").eqNullSafe(F.col("other"))).select("a", "b", "similarity")


def _again(confidence: Column, times: Column, evidence: float) -> Column:
    """Confidence after the same evidence, given a number of times."""
    return F.aggregate(F.sequence(F.lit(1), times), confidence, lambda c, _: scalars.bayes(c, F.lit(evidence)))


def _refused(memories: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` that can be done, and those that can't with a ``reason``."""
    known = memories.select("id").distinct()
    one, two = (known.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")) for end in ("a", "b"))
    reason = F.when(F.col("a").eqNullSafe(F.col("b")), "a memory and itself").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "no such memory")
    judged = pairs.select("a", "b").join(one, "a", "left").join(two, "b", "left").select("a", "b", reason.alias("reason"))
    return judged.filter("reason IS NULL").select("a", "b"), judged.filter("reason IS NOT NULL")


def _with_edges(edges: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Edges (``src, dst, kind, weight``) with one of ``kind`` and weight 1 for each pair, in place of that there was."""
    new = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().select("src", "dst", F.lit(kind).alias("kind"), F.lit(1.0).alias("weight"))
    return edges.select("src", "dst", "kind", "weight").join(new, ["src", "dst", "kind"], "left_anti").select("src", "dst", "kind", "weight").unionByName(new)


def _updated(memories: DataFrame, ids: DataFrame, evidence: float) -> DataFrame:
    times = ids.groupBy("id").agg(F.count("*").cast("int").alias("_times"))
    after = F.when(F.col("_times").isNotNull(), _again(F.col("confidence"), F.col("_times"), evidence)).otherwise(F.col("confidence"))
    return memories.join(times, "id", "left").withColumn("confidence", after).drop("_times")


def confirm(memories: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories (``id, confidence``, more) and edges (``src, dst, kind, weight``) after confirmed contradictions (``a, b``).

    Each time a memory is ``a`` it gets evidence 0.1, the ``hebbian`` edge between the two (lesser id first) keeps a tenth, and ``a`` contradicts ``b`` with weight 1.
    """
    times = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("_times"))
    fainter = edges.join(times.withColumn("kind", F.lit("hebbian")), ["src", "dst", "kind"], "left")
    fainter = fainter.withColumn("weight", F.col("weight") * F.pow(F.lit(0.1), F.coalesce("_times", F.lit(0))))
    return _updated(memories, pairs.select(F.col("a").alias("id")), AGAINST), _with_edges(fainter, pairs, "contradicts")


def support(memories: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, edges, and refused pairs with a ``reason``, after ``a`` was said to support ``b``: evidence 0.65 for ``b`` each time."""
    good, bad = _refused(memories, pairs)
    return _updated(memories, good.select(F.col("b").alias("id")), FOR), _with_edges(edges, good, "supports"), bad


def supersede(memories: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories (``id, state``, more), edges, and refused pairs with a ``reason``, after ``a`` took the place of ``b``, which is archived."""
    good, bad = _refused(memories, pairs)
    gone = good.select(F.col("b").alias("id")).distinct().withColumn("_gone", F.lit(True))
    after = memories.join(gone, "id", "left").withColumn("state", F.when(F.col("_gone"), "archived").otherwise(F.col("state"))).drop("_gone")
    return after, _with_edges(edges, good, "supersedes"), bad
