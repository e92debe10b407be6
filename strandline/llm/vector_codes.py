"""Vector compression: product codes with integer codebooks, learned by exact nearest-entry rounds.

Components become whole numbers floor(scale * x), so that distances, means and ties are exact. Nearest entries are found by one float32 matrix
product a part. Its rounding error is bounded by gamma_d * |x| * |c|, whatever the order of the sums, so every entry has an interval that
holds its true distance; entries whose interval reaches below the best upper end are worked out again in int64, and the least
index wins among equals.

Null vectors, and those with null or non-finite components, are dropped, as are those whose length isn't the most frequent one (ties: the longest).
Null ids come last when the first codebooks are chosen, equal ids in order of their vectors. An empty table gives an empty one, fewer vectors
than entries give so many entries. Components of over 2**13 in size, at the scale of 4096, are refused with an error: int64
could not hold their distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Largest whole-number component; squares of differences over 1000 components stay below 2**63.
MOST = 1 << 25
#: A label with at least this share of the rows is joined by broadcast, of which there are at most so many.
HOT = 1 / 256


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` whole numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row (ties: the least index), its exact squared distance, and how many rows needed int64 to decide."""
    d = x.shape[1]
    u = 2.0**-24
    gamma = (d + 2) * u / (1 - (d + 2) * u)  # the sums, and the rounding of both factors
    square = (book * book).sum(axis=1)
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    score = square - 2 * product  # |x - c|^2 without |x|^2, which all entries share
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(square.astype(np.float64))
    half = (2 * gamma * size + 2.0**-50 * (square + 2 * np.abs(product))) * (1 + 2.0**-20)
    open_ = score - half <= (score + half).min(axis=1, keepdims=True)
    best = open_.argmax(axis=1)
    many = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(many):
        row, entry = np.nonzero(open_[many])
        gap = x[many[row]] - book[entry]
        exact = np.full((len(many), len(book)), np.iinfo(np.int64).max)
        exact[row, entry] = (gap * gap).sum(axis=1)
        best[many] = exact.argmin(axis=1)
    gap = x - book[best]
    return best, (gap * gap).sum(axis=1), len(many)


def usable(vectors: DataFrame, key: str, vec: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """``key, label, v`` (whole numbers) of the vectors that can be coded, written to the shared folder, and their length."""
    good = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(good)
    sizes = kept.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if sizes is None:
        return cut(vectors.limit(0).select(F.col(key).alias("key"), F.col(label).alias("label"), F.lit(None).cast("array<int>").alias("v")), "codes"), 0
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    whole = F.when(F.exists(whole, lambda x: F.abs(x) > MOST), F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(whole)
    return cut(kept.filter(F.size(vec) == sizes["d"]).select(F.col(key).alias("key"), F.col(label).alias("label"), whole.cast("array<int>").alias("v")), "codes"), sizes["d"]


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry is the floor of the mean of what is nearest to it; unused ones stay.

    Tasks return counts and sums of their own entries, at most parts x entries rows each, so what is shuffled and collected is as large as the
    codebooks, whatever the number of vectors.
    """
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                best, _, _ = nearest_entries(x[:, p], books[p])
                order = np.argsort(best, kind="stable")
                used, start, many = np.unique(best[order], return_index=True, return_counts=True)
                n[p, used] += many
                if len(used):
                    total[p, used] += np.add.reduceat(x[order, p], start, axis=0)
        at = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at]), pa.array(total.reshape(-1, width)[at].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    each = rows.select("v").mapInArrow(sums, "slot long, n long, total array<bigint>")
    found = each.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total")).collect()
    new = books.reshape(-1, width).copy()
    for r in found:
        new[r["slot"]] = np.array(r["total"], np.int64) // r["n"]  # floors go down
    return new.reshape(books.shape)


def learn(rows: DataFrame, dims: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks ``[part, entry, position]``, begun at the vectors with the least ids."""
    if dims % parts:
        raise ValueError(f"vectors of {dims} components have no {parts} equal parts")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refine(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``key, label, code, error``: entry indexes in part order, two hex digits each, and the squared distance to what they stand for."""
    parts, _, width = books.shape
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            at, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at[:, p], gap, _ = nearest_entries(x[:, p], books[p])
                error += gap
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([bytes(a).hex() for a in at], pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    return rows.mapInArrow(codes, f"key {kind['key']}, label {kind['label']}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum over rows of the same label (nulls together); labels with many rows are joined without a shuffle of them."""
    sums = cut(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    total = sums.agg(F.sum("n")).head()[0] or 0
    hot = F.col("n") >= max(1, total * HOT)
    same = F.col("label").eqNullSafe(F.col("_label"))
    side = sums.withColumnRenamed("label", "_label")
    large = F.broadcast(side.filter(hot).drop("n"))  # at most 1 / HOT rows
    there = coded.join(large, same).drop("_label")
    rest = coded.join(F.broadcast(side.filter(hot).select("_label")), same, "left_anti").join(side.filter(~hot).drop("n"), same).drop("_label")
    return there.unionByName(rest)


def compress(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """``key, label, code, error`` of all usable vectors, and the codebooks; ``entries`` up to 256."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows, dims = usable(vectors, key, vec, label, scale)
    if not dims:
        return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = learn(rows, dims, parts, entries, rounds)
    return encode(rows, books), books


def decode(coded: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """``key, vector``: what the codes stand for."""
    parts, _, width = books.shape
    kind = coded.schema["key"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, parts)
            v = np.concatenate([books[p][at[:, p]] for p in range(parts)], axis=1) / scale
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(v.tolist(), pa.list_(pa.float64()))], ["key", "vector"])

    return coded.select("key", "code").mapInArrow(vectors, f"key {kind}, vector array<double>")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(vectors: DataFrame, **how) -> DataFrame:
    coded, books = compress(vectors, **how)
    return with_label_errors(cut(coded, "coded")).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
