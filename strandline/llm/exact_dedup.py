"""Exact deduplication over an extendible-hash index on shared files, in DataFrame functions only.

1. Texts are hashed to 64 bits, and hashes counted with their rows.
2. The directory starts with one bucket; while a bucket holds more than ``capacity`` hashes it is split by the next
   bit, and the directory doubles when the bucket's depth passes its own. It is kept down to ``DEPTH_MOST`` bits, a bound on what the driver
   holds and sends whatever the input; deeper splits need no directory, since a bucket that is still too full says by its count into how many
   equal ranges of hashes it falls (``sub``).
3. Rows go to owner tasks by bucket, each a range of hashes. A hash with more than ``capacity`` rows (and than a ``HOT``-th of all; at most ``HOT`` hashes)
   is salted over several owners and put together after them. Owners compare texts byte by byte, chain different ones that share a hash,
   and write their entries to the shared folder as Parquet files.
4. Rows probe the files by hash and SHA-256, and the answer is what they find there. Should two different texts ever share both, which is looked for,
   the probe compares the bytes as well.

Null counts as empty text. Every row gets a row; of equal texts the row with the largest id stays (null ids are
smallest; of rows with that same id, one). Very long texts are read whole, an empty table gives an empty one. Other columns are
ignored here, and kept as they are by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_rows, scratch

CAPACITY, DEPTH_MOST, HOT = 2_000, 14, 4096


def directory(counts: dict[int, int], capacity: int = CAPACITY, most: int = DEPTH_MOST) -> list[tuple[int, int]]:
    """Buckets as (first cell, local depth) from row counts by cell of ``most`` bits; together they cover all cells."""
    depth, buckets = 0, [(0, 0)]
    total = [0]
    for cell in range(1 << most):
        total.append(total[-1] + counts.get(cell, 0))
    while True:
        split = []
        for first, local in buckets:
            width = 1 << (most - local)
            if local < most and total[first + width] - total[first] > capacity:
                split += [(first, local + 1), (first + width // 2, local + 1)]
            else:
                split.append((first, local))
        if len(split) == len(buckets):
            return buckets
        depth += 1  # the directory doubles
        buckets = split


def _cell(h: str, most: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - most).cast("int") if most else F.lit(0)


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, most: int = DEPTH_MOST) -> DataFrame:
    """One row per document row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), full.alias("text"), F.xxhash64(full).alias("h"))
    counts = cut(rows.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    cells = counts.groupBy(_cell("h", most).alias("cell")).agg(F.count("*").alias("hashes"), F.sum("n").alias("n")).collect()  # 2**most rows at most
    held, total = {r["cell"]: r["hashes"] for r in cells}, sum(r["n"] for r in cells)
    buckets = directory(held, capacity, most)
    fan = [-(-sum(held.get(c, 0) for c in range(first, first + (1 << (most - local)))) // capacity) if local == most else 1 for first, local in buckets]
    places = spark.createDataFrame([(c, b, max(1, fan[b])) for b, (first, local) in enumerate(buckets) for c in range(first, first + (1 << (most - local)))], "cell int, bucket int, fan int")
    hot = counts.filter(F.col("n") > max(capacity, total // HOT)).select("h", F.ceil(F.col("n") / capacity).cast("int").alias("salts"))

    placed = rows.withColumn("cell", _cell("h", most)).join(F.broadcast(places), "cell").join(F.broadcast(hot), "h", "left")  # hot has HOT rows at most
    below = F.shiftrightunsigned("h", 48 - most).bitwiseAND(F.lit(65535))
    placed = placed.withColumns({"sub": F.floor(below * F.col("fan") / 65536).cast("int"), "salt": F.coalesce(F.pmod(F.spark_partition_id(), "salts"), F.lit(0))})
    owner = placed.select("bucket", "sub", "salt", "h", "text", "doc_id").repartition("bucket", "sub", "salt")
    entries = owner.groupBy("bucket", "sub", "salt", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = entries.select("bucket", "sub", "salt", "h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    # an owner has one entry a text: two of one digest are two texts
    merged = entries.repartition("bucket", "sub").groupBy("bucket", "sub", "h", "text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), (F.count("*") > F.max("salt") + 1).alias("collides"))
    path = scratch(spark, "index")
    chain = Window.partitionBy("bucket", "sub", "h").orderBy("text_sha256")
    merged.withColumn("chain", F.row_number().over(chain)).write.parquet(path)
    index = spark.read.parquet(path)
    probes = rows.withColumn("text_sha256", F.sha2("text", 256))
    if index.filter("collides").isEmpty():
        entries, key = index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"]
    else:
        entries, key = probes.groupBy("h", "text_sha256", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), ["h", "text_sha256", "text"]
    same = probes.groupBy(*key, "doc_id").agg(F.count("*").alias("copies"))
    out = same.join(entries, key).select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each group of equal texts, all columns as they are; of repeated rows one stays."""
    out = exact_classes(docs, doc_id, text).filter(~F.col("kept"))
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keys = lambda rows: rows.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key")).distinct()
    return drop_rows(docs, doc_id, text, keys(out.filter(~last)), keys(out.filter(last)))
