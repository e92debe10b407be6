"""A queue of memories that may contradict each other: fed by a stream of new ones, emptied by verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.contradictions import candidates
from strandline.operators.lineage import cut

from .store import Store

#: Verdicts that there are.
VERDICTS = ("confirmed", "dismissed")


class Queue:
    """Candidates ``a, b, nth, similarity, status, judged``: pairs of memories, the n-th time they were flagged (from 0), and the batch that judged them.

    A pair is pending once at most; one that was judged may be flagged again. Flags and verdicts are batches of one number line: a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", buckets: int = 64) -> None:
        self.spark = spark
        self.store = Store(spark, path, f"a {kind}, b {kind}, nth int, similarity double, status string, judged bigint", ["a", "b"], buckets)

    def read(self) -> DataFrame:
        return self.store.read()

    def next_batch(self) -> int:
        known = self.store.batches()
        return known[-1] + 1 if known else 0

    def flag(self, batch: int, found: DataFrame) -> bool:
        """Adds candidates (``a, b, similarity``) that aren't pending; of repeated ones the most similar. Whether the batch was new."""

        def fold(known: DataFrame, new: DataFrame) -> DataFrame:
            been = known.groupBy("a", "b").agg(F.count("*").cast("int").alias("nth"), F.count_if(F.col("status") == "pending").alias("open"))
            added = new.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).join(been, ["a", "b"], "left").filter("coalesce(open, 0) = 0")
            rows = added.select("a", "b", F.coalesce("nth", F.lit(0)).alias("nth"), "similarity", F.lit("pending").alias("status"), F.lit(None).cast("long").alias("judged"))
            return known.unionByName(rows)

        return self.store.update(batch, cut(found.select("a", "b", "similarity")), fold)

    def refused(self, batch: int, verdicts: DataFrame) -> DataFrame:
        """``a, b, verdict, reason`` of verdicts that a batch can't or couldn't take."""
        state = self.read().groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("open"), F.max(F.col("judged") == batch).alias("mine"))
        own = verdicts.select("a", "b", "verdict").withColumn("said", F.count("*").over(Window.partitionBy("a", "b"))).join(state, ["a", "b"], "left")
        reason = F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "no such verdict").when(F.col("said") > 1, "judged twice").when(F.col("n").isNull(), "no such candidate")
        reason = reason.when((F.col("open") == 0) & ~F.coalesce("mine", F.lit(False)), "judged already")
        return own.withColumn("reason", reason).filter("reason IS NOT NULL").select("a", "b", "verdict", "reason")

    def resolve(self, batch: int, verdicts: DataFrame) -> DataFrame:
        """Takes verdicts (``a, b, verdict``) on pending candidates; gives those it refused, with a ``reason``. One bad verdict doesn't hold up the others."""
        said = cut(verdicts.select("a", "b", "verdict"))
        bad = cut(self.refused(batch, said))
        good = said.join(bad.select("a", "b"), ["a", "b"], "left_anti")

        def fold(known: DataFrame, new: DataFrame) -> DataFrame:
            hit = (F.col("status") == "pending") & F.col("verdict").isNotNull()
            rows = known.join(new, ["a", "b"], "left")
            return rows.withColumn("judged", F.when(hit, F.lit(batch)).otherwise(F.col("judged"))).withColumn("status", F.when(hit, F.col("verdict")).otherwise(F.col("status")))

        self.store.update(batch, good, fold)
        return bad

    def confirmed(self, batch: int) -> DataFrame:
        """``a, b`` that a batch of verdicts confirmed."""
        return self.read().filter((F.col("judged") == batch) & (F.col("status") == "confirmed")).select("a", "b")

    def pending(self, memories: DataFrame, most: int = 50) -> DataFrame:
        """What waits for a verdict in each space, the most similar first, ``most`` of each, with both sides' ``content`` and ``confidence``; candidates of unknown memories don't show."""
        side = lambda end: memories.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("space", "content", "confidence")))
        rows = self.read().filter("status = 'pending'").join(side("a"), "a").join(side("b").drop("space_b"), "b").withColumnRenamed("space_a", "space")
        place = F.row_number().over(Window.partitionBy("space").orderBy(F.desc("similarity"), "a", "b"))
        return rows.withColumn("place", place).filter(F.col("place") <= most).drop("status", "judged")


def flag_stream(new: DataFrame, memories: Callable[[], DataFrame], path: str, checkpoint: str, least: float = 0.85, most: int = 50, buckets: int = 64) -> StreamingQuery:
    """Flags a stream of new memories (``id``) against what ``memories()`` holds when their batch comes.

    Each batch takes the queue's next number, so verdicts may come between batches, from the same writer. One that is run again after a failure finds its candidates pending and adds
    none; only those judged between the failure and the repeat are flagged a second time.
    """
    queue = Queue(new.sparkSession, path, new.schema["id"].dataType.simpleString(), buckets)

    def batch(df: DataFrame, n: int) -> None:
        queue.flag(queue.next_batch(), candidates(memories(), df, least, most))

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
