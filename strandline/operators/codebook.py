"""A codebook of directions, fitted over all vectors, and how far each vector is from its nearest entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .search import matrices


def _nearest(unit: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = unit @ books.T
    at = scores.argmax(axis=1)
    return at, scores[np.arange(len(unit)), at]


def _size(vectors: DataFrame, vec: str) -> int | None:
    """The most frequent length of vectors, of equally frequent ones the largest."""
    row = vectors.filter(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return row and row["d"]


def fit(vectors: DataFrame, cells: int, rounds: int = 50, key: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """Unit entries, ``cells`` at most: the directions of the vectors of the least keys, then rounds of means over all vectors until no entry moves by over 1e-9.

    Vectors of the most frequent length count; null, empty, zero and broken ones and null keys don't. An entry that nothing is nearest to, or whose mean is zero, stays; of equally near
    entries the first is taken. A round is one scan, whose tasks give back a count and a sum for each entry; the driver holds ``cells`` entries.
    """
    if cells < 1 or rounds < 0:
        raise ValueError("cells must be 1 or more, rounds 0 or more")
    size = _size(vectors, vec)
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")).filter("key IS NOT NULL")
    if size is None:
        return np.zeros((0, 0))
    usable = rows.filter(f"size(vec) = {size} AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vec, x -> x <> 0)")
    first = usable.orderBy("key", F.xxhash64("vec")).limit(cells).toArrow()
    found = matrices(first.column("vec"))
    if size not in found:
        return np.zeros((0, 0))
    books = found[size][0]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(books)
            for batch in batches:
                own = matrices(batch.column("vec")).get(size)
                if own is not None:
                    np.add.at(total, _nearest(own[0], books)[0], own[0])
            at, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(i), pa.array(total[at, i])], ["cell", "i", "x"])

        got = usable.select("vec").mapInArrow(sums, "cell long, i long, x double").groupBy("cell", "i").agg(F.sum("x").alias("x")).toArrow()
        mean = np.zeros_like(books)
        mean[got.column("cell").to_numpy(), got.column("i").to_numpy()] = got.column("x").to_numpy()
        norm = np.sqrt((mean * mean).sum(axis=1))
        new = np.where(norm[:, None] > 1e-12, mean / np.maximum(norm, 1e-12)[:, None], books)
        moved, books = np.abs(new - books).max(), new
        if moved <= 1e-9:
            break
    return books


def residuals(vectors: DataFrame, books: np.ndarray, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``key, cell, residual``: the nearest entry of each vector and 1 - its cosine; both null for vectors of another length or without a direction. Every row is kept."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            own = matrices(batch.column("vec")).get(books.shape[1])
            if own is not None and len(books):
                cell[own[1]], near = _nearest(own[0], books)
                far[own[1]] = 1 - near
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(arrow), pa.array(cell, mask=cell < 0), pa.array(far, mask=cell < 0)], ["key", "cell", "residual"])

    return rows.mapInArrow(one, f"key {kind.simpleString()}, cell long, residual double").withColumnRenamed("key", key)
