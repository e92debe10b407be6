"""Handing events on from a working store to a shared one, by event id: exactly once, without gaps, whatever is sent again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.lineage import cut

from .store import Store


class Flush:
    """Ships each session's events in order of their ids, up to the first that isn't ready (has no vector yet).

    The state of a session is its mark, the last id shipped, and the events held back behind it. An event that comes again replaces the one held if it is ready
    and that one isn't; ids up to the mark are known and dropped. Shipped rows of a batch lie in ``out/batch=<n>`` and count once the state's log has the batch, so a batch that
    was killed anywhere, or comes again, ships nothing twice and loses nothing. Events without a session or id are left out.
    """

    def __init__(self, events: DataFrame, path: str, by: str, key: str, ready: Column, buckets: int = 64) -> None:
        self.spark, self.path, self.by, self.key, self.ready = events.sparkSession, path, by, key, ready
        self.columns = events.columns
        taken = {c.lower() for c in events.columns}
        self.mark = next(n for n in ("_mark", "__mark", "___mark") if n not in taken)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
        self.schema = fields
        self.store = Store(self.spark, f"{path}/state", f"{fields}, {self.mark} boolean", [by], buckets)

    def batch(self, new: DataFrame, n: int) -> bool:
        """Takes a batch; whether it was new."""
        return self.store.update(n, new.select(*self.columns).filter(F.col(self.by).isNotNull() & F.col(self.key).isNotNull()), lambda state, rows: self._step(state, rows, n))

    def _step(self, state: DataFrame, new: DataFrame, n: int) -> DataFrame:
        by, key, mark = self.by, self.key, self.mark
        marks = state.filter(mark).groupBy(by).agg(F.max(key).alias("_last"))
        held = state.filter(f"NOT {mark}").select(*self.columns)
        ready = F.coalesce(self.ready, F.lit(False))
        order = Window.partitionBy(by, key).orderBy(ready.desc(), F.hash(*self.columns))
        pending = held.unionByName(new).join(marks, by, "left").filter(F.col("_last").isNull() | (F.col(key) > F.col("_last")))
        pending = pending.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").withColumn("_ready", ready)
        stop = pending.groupBy(by).agg(F.min(F.when(~F.col("_ready"), F.col(key))).alias("_stop"))
        pending = cut(pending.join(stop, by).withColumn("_goes", F.col("_stop").isNull() | (F.col(key) < F.col("_stop"))))
        shipped = pending.filter("_goes")
        shipped.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/out/batch={n}")
        last = shipped.groupBy(by).agg(F.max(key).alias("_last")).unionByName(marks).groupBy(by).agg(F.max("_last").alias(key))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (by, key) else F.col(f.name) for f in new.schema]
        return pending.filter("NOT _goes").select(*self.columns, F.lit(False).alias(mark)).unionByName(last.select(*empty, F.lit(True).alias(mark)))

    def shipped(self) -> DataFrame:
        """All rows of batches that count, with their ``batch``."""
        paths = [f"{self.path}/out/batch={n}" for n in self.store.batches()]
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", f"{self.path}/out").parquet(*paths) if paths else self.spark.createDataFrame([], f"{self.schema}, batch long")

    def of_batch(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/out/batch={n}")

    def held(self) -> DataFrame:
        return self.store.read().filter(f"NOT {self.mark}").select(*self.columns)


def flush_stream(events: DataFrame, path: str, checkpoint: str, by: str, key: str, ready: Column, after: Callable[[DataFrame, int], None] | None = None, buckets: int = 64) -> StreamingQuery:
    """Flushes a stream of events. ``after`` gets the rows that a batch shipped once it counts, outside of it: what it does may be lost, and its failure stops nothing."""
    flush = Flush(events, path, by, key, ready, buckets)

    def batch(df: DataFrame, n: int) -> None:
        if flush.batch(df, n) and after is not None:
            try:
                after(flush.of_batch(n), n)
            except Exception as e:  # best effort by contract
                print(f"after batch {n}: {e}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
