"""Vector search on odd batches, and the index against exact search."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import consolidate, memory, search, vector_index

VECTORS = "vec_id long, embedding array<double>"


def hits(df):
    return sorted((r.query, r.key, r["rank"], round(r.score, 6)) for r in df.collect())


def asked(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"query {kind}, vec array<double>")


def test_every_length_meets_its_own(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])], VECTORS).coalesce(1)
    assert hits(search.nearest(vectors, asked(spark, [(7, [1.0, 0.0, 0.0])]), 2)) == [(7, 1, 1, 1.0)]
    got = hits(search.nearest(vectors, asked(spark, [(7, [1.0, 0.0, 0.0]), (8, [2.0, 4.0]), (9, [2.0, -1.0])]), 2))
    assert got == [(7, 1, 1, 1.0), (8, 2, 1, 1.0), (8, 3, 2, 1.0), (9, 2, 1, 0.0), (9, 3, 2, 0.0)]


def test_odd_vectors_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])], VECTORS)
    good = spark.createDataFrame([(1, [1.0, 1.0])], VECTORS)
    one = asked(spark, [(7, [1.0, 0.0])])
    for vectors, queries in [(odd, one), (good.filter("false"), one), (good, one.filter("false")), (good, asked(spark, [(7, None), (8, [])])), (good, asked(spark, [(7, [1.0])]))]:
        assert search.nearest(vectors, queries, 3).collect() == []
    assert [(r.query, r.key, r.score) for r in search.all_scores(odd, one).collect()] == [(7, k, 0.0) for k in range(1, 7)]


@pytest.mark.parametrize("block", [2048, 3])
def test_scores_of_all_pairs(spark, monkeypatch, block):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    monkeypatch.setattr(search, "BLOCK", block)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {(r.query, r.key): r.score for r in search.all_scores(vectors, asked(spark, [(str(i), v) for i, v in rows[:10]], "string")).collect()}
    unit = lambda v: np.array(v) / math.sqrt(sum(x * x for x in v))
    assert got == {(str(i), j): pytest.approx(float(unit(v) @ unit(w))) for i, v in rows[:10] for j, w in rows}


def test_plan_of_many_blocks_is_one_scan(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 5)
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    found = search.nearest(vectors, vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), 3)
    assert found._jdf.queryExecution().toString().count("FileScan") == 1 and found.count() == 180


def grouped(rng, n, dims=16, groups=12):
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(heads)]) for i in range(n)]


def test_index_against_exact_search(spark, tmp_path):
    rng = random.Random(3)
    rows = grouped(rng, 1500) + [(5000, None), (5001, []), (5002, [0.0] * 16), (None, [1.0] * 16), (5003, [1.0, 2.0]), (5004, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    queries = asked(spark, [(r[0], r[1]) for r in rows[:1500:50]] + [(9000, [1.0, 1.9]), (9001, None), (9002, [1.0] * 3)])
    path = str(tmp_path / "index")
    vector_index.build(vectors, path, k=20)
    assert spark.read.parquet(f"{path}/lists").count() == 1502  # every row with a direction and a key
    exact, found = search.nearest(vectors, queries, 20), vector_index.search(spark, path, queries, 20)
    assert vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.95
    assert {r.key: r["rank"] for r in found.filter("query = 9000").collect()} == {5003: 1, 5004: 2}
    every = vector_index.search(spark, path, queries, 20, probes=10**6)
    assert hits(every) == hits(exact)
    few = vector_index.search(spark, path, queries.filter("query < 50"), 20, probes=1)
    scan = few._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", scan)


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], VECTORS)
    vector_index.build(empty, str(tmp_path / "a"))
    assert vector_index.search(spark, str(tmp_path / "a"), asked(spark, [(1, [1.0])]), 3).collect() == []
    vector_index.build(spark.createDataFrame([(1, [1.0, 0.0])], VECTORS), str(tmp_path / "b"))
    assert vector_index.search(spark, str(tmp_path / "b"), asked(spark, []), 3).collect() == []


def test_operators_keep_columns_of_the_same_names(spark):
    rows = spark.createDataFrame([("a", 1, "x", 5, 9, 8), ("a", 2, "x", 5, 9, 8), ("a", 3, "y", 5, 9, 8)], "g string, turn int, community string, cost int, place int, before int")
    got = memory.round_robin(rows, "g", "community", 10, ["turn"])
    assert got.columns == rows.columns and {r.turn for r in got.collect()} == {1, 3}
    texts = rows.withColumn("t", F.lit("abcdefgh"))
    cut = consolidate.first_tokens(texts, "g", "turn", "t", 3)
    assert cut.columns == texts.columns and sorted((r.turn, r.t, r.before) for r in cut.collect()) == [(1, "abcdefgh", 8), (2, "abcd", 8)]
