"""Queries that stream their table in several batches, with a restart between, each beside the SQL of the same result over the whole table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.operators.lineage import scratch
from strandline.streaming import coactivation, sessions
from strandline.streaming.flush import Flush, flush_stream

from .q_recall import _EDGES
from .registry import query, table


def _arriving(rows: DataFrame, path: str, order: str, batches: range, of: int) -> Iterator[int]:
    """Writes some of the parts of a table to the folder that a stream reads, one at each step: rows come in order of a number, cut at its quantiles.

    A stream that is run to its end at each step takes a part as one batch, however many files it has, so the parts stay in order.
    """
    cuts = rows.approxQuantile(order, [i / of for i in range(1, of)], 0.01) if of > 1 else []
    part = sum([(F.col(order) > c).cast("int") for c in cuts], F.lit(0))
    for b in batches:
        rows.filter(part == b).write.mode("append").parquet(path)
        yield b


def _stream(spark, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


_LATE = "event_id % 50 = 7 AND epoch_us(ts) < (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 FROM events)"


@query(
    "st05_stream_sessions",
    f"""WITH e AS (SELECT * FROM events WHERE NOT ({_LATE})),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 4 HOURS THEN 1 ELSE 0 END AS new FROM e))
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 4 HOURS <= (SELECT max(ts) FROM e) - INTERVAL 30 MINUTES""",
)
def stream_sessions(spark, sf_dir):
    """Sessions of four idle hours: events come up to 20 minutes out of order, some come at the very end and are dropped, and the stream is stopped and started again after each part."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(us).alias("first"), F.max(us).alias("last"))  # one row
    late = (F.col("event_id") % 50 == 7) & (us < F.col("first") + F.expr("(last - first) div 4"))
    came = F.when(late, F.col("last")).otherwise(us).cast("double") + F.pmod(F.xxhash64("event_id"), F.lit(20)) * 60e6
    rows = events.crossJoin(F.broadcast(span)).withColumn("came", came).drop("first", "last")
    path, out, checkpoint = (scratch(spark, n) for n in ("arrivals", "sessions", "checkpoint"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    try:
        for _ in _arriving(rows, path, "came", range(5), 5):  # each part's stream starts from the checkpoint of the one before
            closed = sessions.closed_sessions(_stream(spark, path, rows), ["user_id"])
            closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema("user_id long, started long, ended long, n long").parquet(out)


@query(
    "st02_stream_flush",
    """WITH e AS (SELECT user_id, event_id, event_id % 13 = 0 AND event_id % 2 = 1 AS never FROM events)
SELECT user_id, count(*) AS shipped, max(event_id) AS mark FROM e WHERE event_id < coalesce((SELECT min(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.never), 9223372036854775807) GROUP BY user_id""",
)
def stream_flush(spark, sf_dir):
    """Events handed on by id: every thirteenth comes without a vector, of which those of even id are sent again with one at the end; the stream is stopped and started again after each part, and the first part comes again."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 13 != 0).alias("embedded"))
    again = events.filter("event_id % 26 = 0").withColumn("embedded", F.lit(True))
    path, out, checkpoint = (scratch(spark, n) for n in ("arrivals", "flushed", "checkpoint"))
    for _ in chain(_arriving(events, path, "event_id", range(4), 4), _arriving(again, path, "event_id", range(1), 1), _arriving(events, path, "event_id", range(1), 4)):
        flush_stream(_stream(spark, path, events), out, checkpoint, "user_id", "event_id", F.col("embedded"), buckets=8).awaitTermination()
    shipped = Flush(events, out, "user_id", "event_id", F.col("embedded"), buckets=8).shipped()
    return shipped.groupBy("user_id").agg(F.count("*").alias("shipped"), F.max("event_id").alias("mark"))


@query("st09_stream_fold", f"SELECT src, dst, n, round(weight, 9) AS weight FROM ({_EDGES})")
def stream_fold(spark, sf_dir):
    """Pairs of an order's parts, enqueued order by order and folded batch by batch into hash buckets; the second half comes after a restart."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    path, out, checkpoint = (scratch(spark, n) for n in ("queue", "edges", "checkpoint"))
    queue = graph.pairs(items, "l_orderkey", "l_partkey", "l_linenumber")
    for half in (0, 1):
        graph.pairs(items.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == half), "l_orderkey", "l_partkey", "l_linenumber").write.mode("append").parquet(path)
        coactivation.fold_stream(_stream(spark, path, queue), out, checkpoint, buckets=8).awaitTermination()
    return coactivation.edges(spark, out, buckets=8).read().select("src", "dst", "n", F.round("weight", 9).alias("weight"))
