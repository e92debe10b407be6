"""A table of state in hash buckets: a batch rewrites only the buckets it touches, and takes effect at once or not at all."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task folds, about.
TASK_ROWS = 1 << 19


class Store:
    """Rows of ``schema``, dealt by ``keys`` into ``buckets`` folders below ``path``.

    ``data/<batch>/_bucket=<n>`` holds what a batch wrote. ``log/<batch>`` lists, for every bucket, the batch that holds it now, and is put in place by a rename: the one
    step that makes a batch count. Work of a batch that was killed before is overwritten when the batch comes again, and a batch that counts already is
    passed over, so a source that sends batches more than once changes nothing. One writer at a time; readers see whole versions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def batches(self) -> list[int]:
        """Batches that count, in order, as far as they are kept."""
        return [int(n) for n in self._names("log") if n.isdigit()]

    def _log(self, batch: int | None = None) -> dict[int, int]:
        known = self.batches()
        if not known:
            return {}
        text = self.spark.read.text(f"{self.path}/log/{known[-1] if batch is None else batch:020d}").head()[0]
        return {int(b): n for b, n in json.loads(text).items()}

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame, n: int = 0) -> tuple[DataFrame, list[Column]]:
        """Rows, about ``n``, those of one place in one task, and what the place is: ``_bucket``, and ``_slot``, a part of the bucket that one task writes.

        What is grouped by the place and more isn't shuffled again. There are as many tasks as in other shuffles, or one for ``TASK_ROWS`` rows.
        """
        tasks = max(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
        slot = F.pmod(F.hash(*self.keys), F.lit(max(1, tasks // self.buckets))).cast("int")
        return rows.repartition(tasks, self.bucket(), slot), [self.bucket().alias("_bucket"), slot.alias("_slot")]

    def read(self, only: list[int] | None = None, batch: int | None = None) -> DataFrame:
        """The rows now, or after a batch, of all buckets or some."""
        paths = [f"{self.path}/data/{n}/_bucket={b}" for b, n in self._log(batch).items() if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def update(self, batch: int, new: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replaces the buckets that ``new`` touches by ``fold(rows there, new)``; whether the batch was new. A failure leaves all as it was.

        Where ``fold`` gives ``_bucket``, from :meth:`dealt`, its rows are taken to be dealt already.
        """
        known = self.batches()
        if known and batch <= known[-1]:
            return False
        touched = [r[0] for r in new.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets
        rows = fold(self.read(touched), new)
        if "_bucket" not in rows.columns:
            rows = self.dealt(rows.select(*self.schema.names))[0].withColumn("_bucket", self.bucket())
        rows.select(*self.schema.names, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{batch}")
        written = {int(n.split("=")[1]) for n in self._names(f"data/{batch}") if n.startswith("_bucket=")}
        log = {b: n for b, n in self._log().items() if b not in set(touched)} | dict.fromkeys(written, batch)
        self._commit(batch, log)
        return True

    def _commit(self, batch: int, log: dict[int, int]) -> None:
        fs, at = self._fs(f"{self.path}/log/{batch:020d}")
        _, draft = self._fs(f"{self.path}/draft/{batch:020d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(log).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if not fs.rename(draft, at):
            raise RuntimeError(f"batch {batch} is there already")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes logs before the last ``keep`` and folders that no kept log names; how many folders went."""
        known, gone = self.batches(), 0
        for n in known[:-keep]:
            fs, at = self._fs(f"{self.path}/log/{n:020d}")
            fs.delete(at, False)
        used = {(n, b) for k in known[-keep:] for b, n in self._log(k).items()}
        for n in [int(x) for x in self._names("data") if known and int(x) <= known[-1]]:
            for b in [x for x in self._names(f"data/{n}") if x.startswith("_bucket=")]:
                if (n, int(b.split("=")[1])) not in used:
                    fs, at = self._fs(f"{self.path}/data/{n}/{b}")
                    gone += fs.delete(at, True)
        return gone
