"""Shared folders, lineage cuts and word arrays for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares (``spark.checkpoint.dir``).

    Only where that setting is absent and Spark runs on one machine, as in tests, a temporary folder is made and set; on a cluster it is an error.
    What is written there must outlive the lazy result that reads it, so it stays until :func:`clear` is called
    or the folder is cleared by its owner.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Paths that this process has handed out.
_made: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes what :func:`scratch` has handed out, once no result is read any more; returns how many paths were there."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


#: Spark's setting by which a job's shuffle files go when it ends; else they stay until the driver collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: ends its lineage, and its shuffle files go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables as :func:`cut` returned them, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1] in {p.rsplit("/", 1)[1] for p in _made}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column) -> Column:
    """SHA-256 of a text, null as the empty one."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with signs before them as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def drop_rows(docs: DataFrame, doc_id: str, text: str, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` and with one row of each of ``repeated``.

    Both have distinct ids and text keys as ``_id, _key``; null ids are ids like others. Of repeated rows that differ in
    other columns, the least as JSON stays.
    """
    a, b, whole = unused(docs, "_id", "_key", "_row")
    on = F.col(doc_id).eqNullSafe(F.col(a)) & (text_key(text) == F.col(b))
    left = docs.join(gone.toDF(a, b), on, "left_anti")
    repeated = cut(repeated, "repeated").toDF(a, b)
    if repeated.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = left.join(repeated, on, "left_semi").groupBy(F.col(doc_id), text_key(text)).agg(F.min_by(row, F.to_json(row)).alias(whole)).select(f"{whole}.*")
    return left.join(repeated, on, "left_anti").unionByName(one)


# --- words -----------------------------------------------------------------------------
# A word is a run of bytes that are digits, letters a-z (A-Z lower-cased) or 0x80 and above:
# on UTF-8 this is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For bytes.translate: lower case, all else that is no word byte becomes a space.
TO_WORDS = bytes(int(LOWER[b]) if WORD_BYTE[b] else 32 for b in range(256))

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well-spread bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null is empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_binary(col.type) else col.cast(pa.large_binary())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the column: (hash, byte start, byte end, first word of each row + end).

    Works in chunks of half a megabyte cut between words, so that beside the 24 bytes a word
    memory doesn't grow with the text.
    """
    data, offs = raw(column)
    n, lo = len(data), 0
    hashes, starts, ends = [], [], []
    while lo < n:
        hi = min(lo + CHUNK, n)
        while hi < n:
            inside = WORD_BYTE[data[hi : hi + 4096]]
            if not inside.all():
                hi += int(inside.argmin())
                break
            hi = min(hi + 4096, n)
        d = data[lo:hi]
        mask = WORD_BYTE[d]
        edge = offs[np.searchsorted(offs, lo, "right") : np.searchsorted(offs, hi, "left")] - lo
        before, after = np.zeros(len(d), bool), np.zeros(len(d), bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        before[edge] = False
        after[edge - 1] = False
        s, e = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        up, down = _power(len(d))
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((LOWER[d].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offs)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values; runs over the end of a row are for the caller to leave out."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[j : len(words) - k + 1 + j]
    return mix(total)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Cut a batch so that each part holds about ``most`` bytes of the column, a row at least."""
    _, offs = raw(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
