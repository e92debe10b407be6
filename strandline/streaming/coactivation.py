"""Streams: co-activation pairs folded into counts, and windowed activity with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.scalars import association_weight
from strandline.operators.graph import added

from .store import Store


def edges(spark: SparkSession, path: str, node: str = "bigint", buckets: int = 64) -> Store:
    """The store of folded pairs."""
    return Store(spark, path, f"src {node}, dst {node}, n bigint, weight double", ["src", "dst"], buckets)


def counted(store: Store, known: DataFrame, new: DataFrame) -> DataFrame:
    """Known counts with new pairs added, shuffled once: they are summed where the store writes them."""
    both = added(new, known)
    dealt, place = store.dealt(both, both.count())
    return dealt.groupBy(*place, "src", "dst").agg(F.sum("n").alias("n")).withColumn("weight", association_weight(F.col("n")))


def fold_stream(pairs: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Folds a stream of ``src, dst`` into the store of :func:`edges`: a batch rewrites only the buckets its pairs fall in, and counts once, however often it is run."""
    store = edges(pairs.sparkSession, path, pairs.schema["src"].dataType.simpleString(), buckets)

    def batch(df: DataFrame, n: int) -> None:
        store.update(n, df, lambda known, new: counted(store, known, new))
        store.vacuum()

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window; events later than ``late`` are left out of closed windows. Works on tables too."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
