"""Streams and their state: what is killed, repeated, late or out of order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.streaming import sessions
from strandline.streaming.coactivation import edges
from strandline.streaming.flush import Flush, flush_stream
from strandline.streaming.store import Store


def rows_of(store):
    return sorted(tuple(r) for r in store.read().collect())


def add(known, new):
    return known.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), "k long, v long", ["k"], 8)
    assert rows_of(store) == [] and store.batches() == []
    assert store.update(0, spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), add)
    one = spark.createDataFrame([(5, 10)], "k long, v long")
    assert store.update(1, one, add)
    log = store._log()
    assert sorted(log.values()).count(1) == 1 and rows_of(store) == sorted((k, 11 if k == 5 else 1) for k in range(100))
    assert not store.update(1, one, add) and not store.update(0, one, add)  # sent again
    assert store.read(batch=0).filter("k = 5").first().v == 1
    assert store.update(2, one, lambda known, new: known.filter("false")) and store.read().count() < 100  # an emptied bucket
    before = rows_of(store)
    assert store.vacuum(1) > 0 and rows_of(store) == before and store.batches() == [2]


@pytest.mark.parametrize("where", ["fold", "commit"])
def test_killed_batch_changes_nothing(spark, tmp_path, monkeypatch, where):
    store = Store(spark, str(tmp_path), "k long, v long", ["k"], 4)
    rows = spark.createDataFrame([(i, 1) for i in range(20)], "k long, v long")
    store.update(0, rows, add)
    before = rows_of(store)

    def die(*_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt), monkeypatch.context() as m:
        if where == "commit":
            m.setattr(Store, "_commit", die)
        store.update(1, rows, die if where == "fold" else add)
    assert rows_of(store) == before and store.batches() == [0]
    assert store.update(1, rows, add) and rows_of(store) == [(k, 2 * v) for k, v in before]


def test_fold_by_batches_is_the_whole_fold(spark, tmp_path):
    rng = random.Random(1)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(300)]
    store = edges(spark, str(tmp_path), buckets=4)
    for b in range(3):
        store.update(b, spark.createDataFrame(pairs[b::3], "src long, dst long"), lambda known, new: graph.fold(new, known))
    want = graph.fold(spark.createDataFrame(pairs, "src long, dst long"))
    assert sorted((r.src, r.dst, r.n) for r in store.read().collect()) == sorted((r.src, r.dst, r.n) for r in want.collect())


EVENTS = "session string, id long, vec array<float>, note string"


def event(s, i, ready=True, note="x"):
    return (s, i, [1.0] if ready else None, note)


def shipped(flush):
    return sorted((r.session, r.id) for r in flush.shipped().collect())


def test_flush_holds_back_and_goes_on(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, EVENTS)
    flush = Flush(make([]), str(tmp_path), "session", "id", F.col("vec").isNotNull(), 4)
    assert shipped(flush) == []
    flush.batch(make([event("a", 2), event("a", 1), event("a", 4), event("a", 3, False), event("b", 1, False), (None, 9, [1.0], "x"), ("a", None, [1.0], "x")]), 0)
    assert shipped(flush) == [("a", 1), ("a", 2)] and flush.held().count() == 3
    flush.batch(make([event("a", 2, note="again"), event("a", 3, False), event("b", 1)]), 1)  # known, not ready again, ready now
    assert shipped(flush) == [("a", 1), ("a", 2), ("b", 1)]
    flush.batch(make([event("a", 3), event("a", 5)]), 2)
    assert shipped(flush) == [("a", i) for i in range(1, 6)] + [("b", 1)] and flush.held().count() == 0
    assert {r.note for r in flush.shipped().collect()} == {"x"}
    assert not flush.batch(make([event("c", 1)]), 2)


def test_killed_flush_ships_nothing_twice(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, EVENTS)
    flush = Flush(make([]), str(tmp_path), "session", "id", F.col("vec").isNotNull(), 4)
    flush.batch(make([event("a", 1)]), 0)

    def die(*_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt), monkeypatch.context() as m:
        m.setattr(Store, "_commit", die)
        flush.batch(make([event("a", 2), event("a", 3)]), 1)
    assert shipped(flush) == [("a", 1)]  # what was written doesn't count
    flush.batch(make([event("a", 2), event("a", 3)]), 1)
    flush.batch(make([event("a", 2), event("a", 3)]), 2)  # the source sends it again as another batch
    assert shipped(flush) == [("a", 1), ("a", 2), ("a", 3)]


def test_what_follows_a_flush_may_fail(spark, tmp_path):
    spark.createDataFrame([event("a", 1), event("a", 2)], EVENTS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    seen = []

    def after(rows, n):
        seen.append(rows.count())
        raise ValueError("queue is down")

    for _ in range(2):
        flush_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "session", "id", F.col("vec").isNotNull(), after, 4).awaitTermination()
    assert seen == [2]


def test_stretches_join_in_any_order():
    rng = random.Random(2)
    for _ in range(200):
        at = sorted(rng.randrange(300) for _ in range(rng.randint(1, 25)))
        cuts = [i for i in range(1, len(at)) if at[i] - at[i - 1] >= 10]
        want = [(at[a], at[b - 1], b - a) for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True)]
        mixed = rng.sample(at, len(at))
        s = e = n = np.zeros(0, np.int64)
        for lo in range(0, len(mixed), 4):
            new = np.array(mixed[lo : lo + 4], np.int64)
            s, e, n = sessions.joined(np.concatenate([s, new]), np.concatenate([e, new]), np.concatenate([n, np.ones(len(new), np.int64)]), 10)
        assert list(zip(s.tolist(), e.tolist(), n.tolist(), strict=True)) == want
