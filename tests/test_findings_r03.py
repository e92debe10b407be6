"""Queries that a review found wrong or too large, each on small tables against its SQL."""

import json
import math
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.operators import communities, compress, density, graph, memory, search
from strandline.plans import load, q_memory
from strandline.plans.registry import ORACLE, QUERIES
from strandline.sources import bundles
from strandline.streaming import coactivation
from strandline.streaming import store as store_of

load()


def shuffled(df, tmp_path):
    """Whether the rows of a plan's result, once found, go through a shuffle."""
    df.write.mode("overwrite").format("noop").save()
    return "Exchange hashpartitioning(query" in df._jdf.queryExecution().executedPlan().toString()


def same(spark, tmp_path, name, files=1, **tables):
    """Whether a query over the tables (table: schema, rows) gives the rows of its SQL; those rows."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    return want


DOCS = "doc_id long, text string, lang string"


def test_f18_runs_at_the_start_of_a_text(spark, tmp_path):
    texts = ["Ö Ö Ö und", "A Big Cat", "A Big", "Big", "x. Big", "x Big", "A", "x A Big", "(A) B! C", "gr\u00e4foo-bar s\u00e4t@me Fo\u00f6BarBaz", "Ann " * 20000, None, ""]
    same(spark, tmp_path, "fn16_entities", documents=(DOCS, [(i, t, "en") for i, t in enumerate(texts)]))


def test_f19_the_word_or_is_a_word(spark, tmp_path):
    texts = ["a b c d one or two", "one and two", "two or one", "or or", "one", "one or x or two", "short one", None]
    docs = [(i * 50 if i < 1 else i, t, "or" if i % 2 else "en") for i, t in enumerate(texts)] + [(50, "a b c d or x y", "en"), (100, "a b c d one", "or"), (150, "a b c d or or one", "or")]
    assert same(spark, tmp_path, "fn05_cover_density", documents=(DOCS, docs))
    assert same(spark, tmp_path, "fn07_weighted_rank", documents=(DOCS, docs))


def test_f17_parts_of_many_files(spark, tmp_path):
    rows = [(i, i % 7, i % 13 != 0) for i in range(600)]
    assert same(spark, tmp_path, "st02_stream_flush", files=5, events=("event_id long, user_id long, embedded boolean", rows))


WORDS = "a b c d e f g h i j or".split()


def many(n):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(14))), rng.choice(["en", "fr", None])) for i in range(n)]
    return docs + [(n + i, docs[i % 50][1], "en") for i in range(n)] + [(2 * n, None, "en")]  # each text again: ties


KEYWORD = ["fn09_bm25", "agg12_max_normalised", "top02_keyword_topk", "top02_keyword_indexed", "top04_keyword_in_scope"]
BOTH = ["agg10_rrf_first_seen", "agg11_rrf_filled", "agg13_seed_mass", "agg29_merged_and_capped", "agg31_best_of_pools", "ml02_three_channels", "recall_fused"]


@pytest.mark.parametrize("name", KEYWORD + BOTH)
def test_f1_to_f9_f13_to_f16_keyword_scores(spark, tmp_path, monkeypatch, name):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(300)]
    monkeypatch.setattr(search, "WORDS", 5)  # several blocks of queries
    monkeypatch.setattr(search, "HELD", 64)  # and many cuts to the best
    tables = {"embeddings": ("vec_id long, embedding array<float>, label int", vectors)} if name in BOTH else {}
    assert same(spark, tmp_path, name, files=3, documents=(DOCS, many(220)), **tables)


def test_f7_pairs_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame(many(60), DOCS)
    asked = docs.filter("doc_id % 50 = 0").selectExpr("doc_id AS query", "explode(split(text, ' ')) AS term")
    assert not shuffled(search.bm25(docs, asked), tmp_path)


VECTORS = "vec_id long, embedding array<float>, label int"


def grouped(n):
    rng = random.Random(8)
    own = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice([0, 1, 2, None])) for i in range(n)]
    return own + [(n + i, own[i % 60][1], own[i % 60][2]) for i in range(n)]  # each of some again: ties


@pytest.mark.parametrize("name", ["jn15_similar_of_a_group", "top01_vector_in_session"])
def test_f20_f21_within_groups(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(search, "BLOCK", 4)
    assert same(spark, tmp_path, name, files=3, embeddings=(VECTORS, grouped(300)))


def test_f20_pairs_are_not_joined(spark, tmp_path):
    spark.createDataFrame(grouped(100), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("jn15_similar_of_a_group", "top01_vector_in_session"):
        assert "Join" not in QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_f22_f23_nothing_is_written_between(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "NUMBERS", 20)
    monkeypatch.setattr(search, "scratch", lambda *_: pytest.fail("written"))
    assert same(spark, tmp_path, "fn01_cosine", files=3, embeddings=(VECTORS, grouped(200)))
    assert same(spark, tmp_path, "fn02_cosine_shorter", files=3, embeddings=(VECTORS, grouped(200)))


def test_f26_f34_a_task_holds_k_rows_a_query(spark):
    rng = random.Random(9)
    scan = spark.createDataFrame([(i % 20, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(400)], "cell int, key long, vec array<float>").coalesce(1)
    unit = np.eye(3)
    targets = {(c, 3): (["a", "b", "b"], unit) for c in range(0, 20, 2)}
    got = search.best_rows(scan, targets, 5, StringType()).groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in got} == {"a": 5, "b": 10}  # before: five of every cell
    names = scan.withColumn("key", F.col("key").cast("string"))
    best = search.top(search.best_rows(names, targets, 5, StringType()), 5).filter("query = 'a'").collect()
    want = sorted(((r.vec[0] / math.hypot(*r.vec), r.key) for r in names.collect() if r.cell % 2 == 0), key=lambda x: (-x[0], x[1]))[:5]
    assert [(r.score, r.key) for r in sorted(best, key=lambda r: r["rank"])] == [(pytest.approx(s), k) for s, k in want]


def shuffles(df):
    """How many shuffles there are in the plan of a result, before it is run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_f28_known_counts_are_added_in_one_grouping(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(200)] + [(None, 1), (None, 1)]
    new, known = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(1, 2, 5), (50, 51, 7), (None, 1, 3)], "src long, dst long, n long")
    want = Counter(pairs) + Counter({(1, 2): 5, (50, 51): 7, (None, 1): 3})
    assert {(r.src, r.dst): r.n for r in graph.fold(new, known).collect()} == want
    assert shuffles(graph.fold(new, known)) == 1  # before: one of pairs, one of counts


def test_f25_a_batch_is_shuffled_once(spark, tmp_path):
    rng = random.Random(4)
    store = coactivation.edges(spark, str(tmp_path), buckets=2)
    first, then = ([(rng.randrange(40), rng.randrange(40)) for _ in range(900)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    seen = []

    def kept(known, new):
        seen.append(coactivation.counted(store, known, new))
        return seen[-1]

    assert store.update(0, frame(first), kept) and store.update(1, frame(then), kept)
    assert {(r.src, r.dst): r.n for r in store.read().collect()} == Counter(first + then)
    assert [shuffles(x) for x in seen] == [1, 1]  # before: three
    assert store.dealt(frame(first), 5 * store_of.TASK_ROWS + 1)[0].rdd.getNumPartitions() == 6  # before: as many tasks, however many rows
    files = [p for p in (tmp_path / "data/1").glob("_bucket=*/*.parquet")]
    assert len({p.parent for p in files}) == 2 and len(files) > 2  # a bucket isn't one task's


def test_f27_bundles_come_in_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"session": {"id": f"{i:08d}-0000-4000-8000-000000000000"}, "events": [{"kind": "x", "tags": ["t"] * (i % 3)}] * (i % 5)}) for i in range(50)))
    monkeypatch.setattr(bundles, "BATCH", 7)
    source = bundles.Bundles({"path": str(tmp_path), "mode": "collect"})
    reader = source.reader(spark.createDataFrame([], bundles.SCHEMA).schema)
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in got) and max(b.num_rows for b in got) == 7  # before: a tuple an event
    rows = bundles.read(spark, str(tmp_path), "collect").collect()
    assert len(rows) == sum(b.num_rows for b in got) == 110 and sum(r.error is not None for r in rows) == 10


def test_f28_more_items_more_tasks(spark, monkeypatch):
    items = spark.createDataFrame([(i // 3, i * 7 % 11, i % 3) for i in range(120)], "o long, p long, n int")
    want = sorted(map(tuple, graph.pairs(items, "o", "p", "n").collect()))
    monkeypatch.setattr(graph, "TASK_ITEMS", 10)
    found = graph.pairs(items, "o", "p", "n")
    assert "hashpartitioning(o" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 12)" in plan  # before: four, as many as shuffles have
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("known", [1 << 18, 4])
def test_f31_words_are_weighed_where_they_are_read(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(q_memory, "WORDS", known)
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{int(rng.random() ** 3 * 40)}" for _ in range(rng.randrange(30))), "en") for i in range(150)] + [(200, None, "en"), (201, "", "en"), (202, "only here", "en")]
    assert same(spark, tmp_path, "fn10_mean_surprise", files=3, documents=(DOCS, docs))
    found = QUERIES["fn10_mean_surprise"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in found and ("hashpartitioning(w" in found) == (known == 4 and "SortMergeJoin [w" in found)  # before: always


def test_f32_f37_few_scores_at_a_time(spark, monkeypatch):
    rng = random.Random(7)
    scan = spark.createDataFrame([(0, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)], "cell int, key long, vec array<float>").coalesce(1)
    want = sorted(map(tuple, search.best_rows(scan, {(0, 3): (["a", "b", "c"], np.eye(3))}, 5, StringType()).collect()))
    monkeypatch.setattr(search, "ROWS", 7)

    def merged(best, keys, scores, k):
        assert scores.shape[1] <= 7  # before: as many as a batch has
        return was(best, keys, scores, k)

    was = search._merged
    monkeypatch.setattr(search, "_merged", merged)
    assert sorted(map(tuple, search.best_rows(scan, {(0, 3): (["a", "b", "c"], np.eye(3))}, 5, StringType()).collect())) == want and len(want) == 15


def test_f33_distances_are_made_in_place():
    rng = np.random.default_rng(3)
    own = pa.chunked_array([pa.array(list(rng.normal(size=(500, 8))))])
    tracemalloc.start()
    d = density._distances(own, own)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.6 * d.nbytes  # before: over three times
    odd = pa.chunked_array([pa.array([[1.0, 0.0], [0.0, 0.0], None, [1.0, 0.0, 0.0], [1.0, 1.0]])])
    assert density._distances(odd, odd)[[0, 0, 1, 3, 0], [0, 1, 1, 3, 4]].round(6).tolist() == [0, 1, 1, 0, round(1 - 0.5**0.5, 6)]


def test_f11_rounds_of_joins_write_little(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(0, a, b, 1.0) for a in range(40) for b in range(a) if rng.random() < (0.6 if a // 10 == b // 10 else 0.1)]
    level, links = communities._graph(spark.createDataFrame([(0, i) for i in range(40)], "g int, n int"), spark.createDataFrame(edges, "g int, src int, dst int, weight double"), "g", "n")
    seen, wishes, cut = Counter(), communities._wishes, communities.cut
    monkeypatch.setattr(communities, "_wishes", lambda *a: seen.update(["rounds"]) or wishes(*a))
    monkeypatch.setattr(communities, "cut", lambda df: seen.update(["written"]) or cut(df))
    moved = communities._moved(level.withColumn("comm", F.col("node")), links).collect()
    assert len(moved) == 40 and len({r.comm for r in moved}) < 10
    assert seen["rounds"] > 2 and seen["written"] <= 3 * seen["rounds"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f35_f39_budgets_stream_sorted_turns(spark):
    rng = random.Random(8)
    rows = [(q, 0, t, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for q in [*range(30), None] for t in range(12)]
    turns = spark.createDataFrame(rows, "query long, session long, turn long, text string")
    scored = turns.selectExpr("*", "length(text) div 4 AS cost", "(turn * 7) % 5 AS less").withColumn("cost", F.when(F.col("turn") != 3, F.col("cost")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a question's turns lie in several batches
    try:
        kept = memory.within_budget(scored, "query", 20, ["less", "turn"])
        got = sorted(((r.query is None, r.query, r.turn) for r in kept.collect()), key=repr)
        assert "FlatMapGroupsInPandas" not in plan_of(kept)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, left = [], {}
    for q, _, t, text in sorted(rows, key=lambda r: (r[2] * 7 % 5, r[2])):
        if t != 3 and len(text) // 4 <= left.setdefault(q, 20):
            left[q] -= len(text) // 4
            want.append((q is None, q, t))
    assert got == sorted(want, key=repr)
    asked = turns.filter("turn = 0").selectExpr("query", "text AS question")
    assert plan_of(compress.compress("extractive_relevance_expanded", turns, asked, 60, compress.bm25)).count("MapInArrow") == 1  # the first choice is made once


def test_f38_small_graphs_one_after_the_other(spark):
    rng = random.Random(6)
    graphs = {g: [(a, b, rng.random() + 0.1) for a in range(9) for b in range(a) if rng.random() < 0.4] for g in range(20)}
    nodes = spark.createDataFrame([(g, n) for g in graphs for n in range(10)], "g int, n int")
    edges = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "g int, src int, dst int, weight double")
    found = communities.leiden(nodes, edges, "g", "n")
    assert "InPandas" not in plan_of(communities._finish(communities._graph(nodes, edges, "g", "n")[0].withColumn("comm", F.col("node")), communities._graph(nodes, edges, "g", "n")[1], 4))
    whole = sorted(map(tuple, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a graph lies in several batches
    try:
        assert sorted(map(tuple, communities.leiden(nodes, edges, "g", "n").collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 200 and all(c <= n for _, n, c in whole)
