"""Ends a lineage by writing a table to the shared folder; runs of equal keys in sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a job's shuffle files go when it ends; else they stay until the driver collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. On one machine without that setting a temporary folder is made and set; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to a ``scratch`` path and read again; the shuffle files of the write go with its end."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "cut")
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def runs(keys: pa.Array) -> Iterator[tuple[object, int, int]]:
    """Runs of equal keys as ``(key, first row, row after the last)``; nulls are equal."""
    coded, lo = pc.run_end_encode(keys), 0
    for key, hi in zip(coded.values.to_pylist(), coded.run_ends.to_pylist(), strict=True):
        yield key, lo, hi
        lo = hi


def drop(spark: SparkSession, *written: str | DataFrame) -> None:
    """Deletes ``scratch`` paths and tables of ``cut``, once nothing reads them any more."""
    paths = {x for w in written for x in ([w] if isinstance(w, str) else [f.rsplit("/", 1)[0] for f in w.inputFiles()])}
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
