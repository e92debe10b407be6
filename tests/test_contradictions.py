"""The queue of contradictions: what is flagged, what verdicts do, what is refused."""

import math

import pytest

from strandline.operators import contradictions
from strandline.operators.lineage import scratch
from strandline.streaming.contradictions import Queue, flag_stream

MEMORIES = "id long, space string, state string, content string, vec array<double>, confidence double"


def turn(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def memories(spark):
    return spark.createDataFrame(
        [
            (1, "x", "active", "tea", turn(0), 0.5),
            (2, "x", "active", "coffee", turn(10), 0.5),
            (3, "x", "active", "tea", turn(5), 0.5),  # says the same as 1
            (4, "x", "archived", "milk", turn(1), 0.5),
            (5, "y", "active", "water", turn(0), 0.5),
            (6, "x", "active", "rum", turn(60), 0.5),
            (7, "x", "active", None, None, 0.5),
            (8, "x", "active", "short", [1.0], 0.5),
            (9, None, "active", "gin", turn(0), 0.5),
            (10, "x", "active", None, turn(20), 0.5),
        ],
        MEMORIES,
    )


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_candidates(spark):
    rows = memories(spark)
    got = {(r.a, r.b): r.similarity for r in contradictions.candidates(rows, ids(spark, 1, 1, 4, 5, 7, 8, 9, 77, None)).collect()}
    assert set(got) == {(1, 2), (1, 10), (4, 1), (4, 2), (4, 3), (4, 10)}  # an archived one is asked about, never found
    assert got[1, 2] == pytest.approx(math.cos(math.radians(10)))
    assert {(r.a, r.b) for r in contradictions.candidates(rows, ids(spark, 1), most=2).collect()} == {(1, 2)}  # its two nearest are 3 and 2
    assert contradictions.candidates(rows.filter("false"), ids(spark, 1)).collect() == []
    assert contradictions.candidates(rows, ids(spark)).collect() == []


def status(queue):
    return sorted((r.a, r.b, r.nth, r.status) for r in queue.read().collect())


def test_queue_stream_and_verdicts(spark, tmp_path):
    rows, where, checkpoint, arrivals = memories(spark), scratch(spark, "queue"), scratch(spark, "checkpoint"), scratch(spark, "arrivals")
    stream = lambda: flag_stream(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(arrivals), lambda: rows, where, checkpoint, buckets=4).awaitTermination()
    ids(spark, 1).coalesce(1).write.mode("append").parquet(arrivals)
    stream()
    queue = Queue(spark, where, buckets=4)
    assert status(queue) == [(1, 2, 0, "pending"), (1, 10, 0, "pending")]
    said = spark.createDataFrame([(1, 2, "confirmed"), (1, 10, "maybe"), (2, 1, "confirmed"), (5, 6, None)], "a long, b long, verdict string")
    n = queue.next_batch()
    for _ in range(2):  # a batch that comes again changes and refuses the same
        bad = {(r.a, r.b): r.reason for r in queue.resolve(n, said).collect()}
        assert bad == {(1, 10): "no such verdict", (2, 1): "no such candidate", (5, 6): "no such verdict"}
        assert status(queue) == [(1, 2, 0, "confirmed"), (1, 10, 0, "pending")]
    assert [tuple(r) for r in queue.confirmed(n).collect()] == [(1, 2)]
    twice = spark.createDataFrame([(1, 2, "dismissed"), (1, 10, "dismissed"), (1, 10, "confirmed")], "a long, b long, verdict string")
    assert {(r.a, r.b, r.reason) for r in queue.resolve(queue.next_batch(), twice).collect()} == {(1, 2, "judged already"), (1, 10, "judged twice")}
    ids(spark, 1, 3).coalesce(1).write.mode("append").parquet(arrivals)
    stream()  # from the checkpoint: only what is new, of which 1 comes again
    assert status(queue) == [(1, 2, 0, "confirmed"), (1, 2, 1, "pending"), (1, 10, 0, "pending"), (3, 2, 0, "pending"), (3, 10, 0, "pending")]
    waits = queue.pending(rows, most=2).orderBy("place").collect()
    assert [(r.a, r.b, r.space, r.content_b, r.place) for r in waits] == [(3, 2, "x", "coffee", 1), (1, 2, "x", "coffee", 2)]


def test_verbs(spark):
    rows = memories(spark).select("id", "state", "confidence")
    edges = spark.createDataFrame([(1, 2, "hebbian", 0.5), (1, 2, "contradicts", 0.3), (2, 1, "hebbian", 0.4), (1, 2, "supports", 0.6)], "src long, dst long, kind string, weight double")
    pairs = lambda *xs: spark.createDataFrame(xs, "a long, b long")
    bayes = lambda p, e: 0.95 * p * e / (p * e + (1 - p) * (1 - e)) + 0.025
    after, links = contradictions.confirm(rows, edges, pairs((2, 1), (2, 3)))
    confidence = {r.id: r.confidence for r in after.collect()}
    assert confidence[2] == pytest.approx(bayes(bayes(0.5, 0.1), 0.1)) and confidence[1] == 0.5
    assert {(r.src, r.dst, r.kind): round(r.weight, 6) for r in links.collect()} == {(1, 2, "hebbian"): 0.05, (1, 2, "contradicts"): 0.3, (2, 1, "hebbian"): 0.4, (1, 2, "supports"): 0.6, (2, 1, "contradicts"): 1.0, (2, 3, "contradicts"): 1.0}
    after, links, bad = contradictions.support(rows, edges, pairs((1, 2), (1, 1), (1, 99), (None, 2)))
    assert {r.id: r.confidence for r in after.collect()}[2] == pytest.approx(bayes(0.5, 0.65))
    assert [r.weight for r in links.filter("kind = 'supports'").collect()] == [1.0]
    assert sorted(r.reason for r in bad.collect()) == ["a memory and itself", "no such memory", "no such memory"]
    after, links, bad = contradictions.supersede(rows, edges, pairs((1, 2), (1, 2)))
    assert {r.id: r.state for r in after.collect()}[2] == "archived" and bad.count() == 0
    assert links.filter("kind = 'supersedes'").count() == 1
