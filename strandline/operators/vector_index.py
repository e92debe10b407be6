"""An index of vectors for approximate search: lists by nearest centroid, written as partitions, a few of which each query reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import best_rows, in_blocks, matrices, nothing, top

#: Vectors that centroids are fitted on, and most centroids.
SAMPLE, MOST_CELLS = 20_000, 4096
#: Rows of a list that one file holds, about.
FILE_ROWS = 1 << 20
#: List of the vectors whose length isn't the index's.
OTHER = -1


def _nearest(unit: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The centroid nearest to each vector, some vectors at a time."""
    return np.concatenate([np.zeros(0, np.int64), *((unit[lo : lo + 1024] @ books.T).argmax(axis=1) for lo in range(0, len(unit), 1024))])


def _fit(unit: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids by rounds of nearest-centroid means; a centroid that nothing is nearest to stays."""
    rng = np.random.default_rng(seed)
    books = unit[rng.choice(len(unit), cells, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(unit, books)
        order = np.argsort(at, kind="stable")
        used, start = np.unique(at[order], return_index=True)
        mean = np.add.reduceat(unit[order], start, axis=0)
        norm = np.sqrt((mean * mean).sum(axis=1))
        good = norm > 1e-12
        books[used[good]] = mean[good] / norm[good, None]
    return books


def _probes(unit: np.ndarray, books: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that hold the asked share of the k nearest, measured within the sample.

    A sample's k nearest lie further off than those of all rows, so the number errs to the safe side.
    """
    near, k, needed = _nearest(unit, books), min(k, len(unit)), []
    for lo in range(0, min(256, len(unit)), 32):
        own = unit[lo : min(lo + 32, 256)]
        best = np.argsort(-(own @ unit.T), axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(own @ books.T), axis=1, kind="stable"), axis=1)  # rank of each list for each query
        needed.append(np.take_along_axis(place, near[best], 1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def build(vectors: DataFrame, path: str, key: str = "vec_id", vec: str = "embedding", cells: int | None = None, k: int = 50, recall: float = 0.97, rounds: int = 8, seed: int = 0) -> None:
    """Writes ``path/lists`` (a folder a centroid) and ``path/about`` (centroids and how many lists to read).

    Centroids are fitted on the ``SAMPLE`` vectors of the most frequent length whose keys have the least hashes; by default there are as many as the square root of
    the rows, up to ``MOST_CELLS``. Every row is indexed: vectors of other lengths have a list of their own. Lists
    with many rows are dealt over several files. Null keys are left out, as are vectors without a direction.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")).filter("key IS NOT NULL AND size(vec) > 0")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    n, dims = (sizes["count"], sizes["d"]) if sizes else (0, 0)
    sample = rows.filter(F.size("vec") == dims).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
    unit = matrices(sample.column("vec")).get(dims, (np.zeros((0, dims)), None))[0]
    cells = min(max(1, cells or round(n**0.5)), MOST_CELLS, len(unit))
    books = _fit(unit, cells, rounds, seed) if cells else np.zeros((0, dims))
    share = np.bincount(_nearest(unit, books), minlength=cells) / max(1, len(unit)) if cells else np.zeros(0)
    files = np.ceil(share * n / FILE_ROWS).astype(np.int64).clip(1)
    about = {"dims": dims, "cells": cells, "probes": _probes(unit, books, k, recall) if cells else 0, "books": books.tolist()}

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, OTHER, np.int32)
            found = np.zeros(batch.num_rows, bool)
            for size, (own, at) in matrices(batch.column("vec")).items():
                found[at] = True
                if size == dims:
                    cell[at] = _nearest(own, books)
            many = np.where(cell >= 0, files[cell.clip(0)] if cells else 1, 64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(many.astype(np.int32)), batch.column("key"), batch.column("vec")], ["cell", "files", "key", "vec"]).filter(pa.array(found))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.mapInArrow(cell_of, f"cell int, files int, key {kinds['key']}, vec {kinds['vec']}")
    # the number of folders that one task writes to is bounded by the hash of list and part
    dealt.repartition(F.col("cell"), F.pmod(F.xxhash64("key"), F.col("files"))).drop("files").write.partitionBy("cell").parquet(f"{path}/lists")
    spark.createDataFrame([(json.dumps(about), kinds["key"], kinds["vec"])], "about string, key string, vec string").coalesce(1).write.parquet(f"{path}/about")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Top-k by cosine within the lists that each query (``query, vec``) reads: ``query, key, score, rank``, scores exact, ties by key.

    The lists are those of the ``probes`` centroids nearest to the query, by default as many as the index found to be enough. Only probed folders are read, and
    a row meets only the queries that read its list. With as many probes as lists the result is exact.
    """
    row = spark.read.parquet(f"{path}/about").head()
    about = json.loads(row["about"])
    dims, cells, books = about["dims"], about["cells"], np.array(about["books"]).reshape(about["cells"], about["dims"])
    probes = min(cells, max(1, probes or about["probes"]))
    kind = queries.schema["query"].dataType
    lists = spark.read.schema(f"key {row['key']}, vec {row['vec']}, cell int").parquet(f"{path}/lists")

    def one(rows: pa.Table) -> DataFrame | None:
        names, targets, read = rows.column("query").to_pylist(), {}, None
        for size, (unit, at) in matrices(rows.column("vec")).items():
            if size != dims:
                targets[OTHER, size] = [names[int(i)] for i in at], unit
            elif cells:
                bits = np.zeros((cells, len(unit)), bool)
                for lo in range(0, len(unit), 256):
                    lists_of = np.argsort(-(unit[lo : lo + 256] @ books.T), axis=1, kind="stable")[:, :probes]
                    bits[lists_of, np.arange(lo, lo + len(lists_of))[:, None]] = True
                read = [names[int(i)] for i in at], unit, np.packbits(bits, axis=1)
        wanted = {c for c, _ in targets} | (set() if read is None else set(np.flatnonzero(read[2].any(axis=1)).tolist()))
        return best_rows(lists.filter(F.col("cell").isin(sorted(wanted))), targets, k, kind, read) if wanted else None

    return top(in_blocks(queries, one, nothing(lists, queries)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query, recall``: the share of each query's exact hits that were found."""
    hit = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
