"""Small cases by hand for the library's own operators."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.functions import rules, scalars
from strandline.operators import graph, memory, metrics, ranking, search, sessions
from strandline.sources import jsonl
from strandline.streaming.coactivation import edges, fold_stream


def test_rrf_with_ties_and_missing_lists(spark):
    rows = [(3, "oak", 2), (3, "elm", 2), (5, "oak", 7), (8, "fir", 1), (8, "oak", 1), (8, "ash", 40)]
    lists = spark.createDataFrame(rows, "tier int, key string, rank int")
    got = {r.key: r for r in ranking.rrf(lists, 10).collect()}
    want = {k: sum(1 / (10 + rank) for _, key, rank in rows if key == k) for k in ("oak", "elm", "fir", "ash")}
    assert {k: r.rrf for k, r in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    assert (got["oak"].first_tier, got["oak"].first_rank, got["ash"].first_tier) == (3, 2, 8)
    assert ranking.rrf(lists, -4).filter("key = 'fir'").first().rrf == pytest.approx(1 / 61)
    assert ranking.rrf(lists.filter("false")).count() == 0


def test_three_channels_by_hand(spark):
    rows = spark.createDataFrame([("p", 0.4, 3.0, 0.9), ("q", 0.1, 6.0, None), ("r", 0.8, None, 0.3), ("s", 0.2, None, None)], "key string, a double, b double, c double")
    tops = (F.lit(0.8), F.lit(6.0), F.lit(0.0))
    got = {r.key: r.s for r in rows.select("key", ranking.fused(F.col("a"), F.col("b"), F.col("c"), tops, 0.25, 0.25).alias("s")).collect()}
    assert got == {"p": pytest.approx(0.25 + 0.125 + 0.225), "q": pytest.approx(0.0625 + 0.25), "r": pytest.approx(1 + 0.075), "s": pytest.approx(0.25)}


def test_bm25_counts_repeated_terms_and_survives_nulls(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a"), (8, "a"), (8, "a"), (9, "zzz")], "query long, term string")
    got = {(r.query, r.key): r.score for r in search.bm25(docs, asked).collect()}
    assert set(got) == {(7, 1), (8, 1)} and got[8, 1] == pytest.approx(2 * got[7, 1])


def test_nearest_against_every_vector(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(300, None), (301, []), (302, [0.0] * 5), (303, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 50 = 0 AND vec_id < 200").selectExpr("vec_id AS query", "embedding AS vec")

    def cos(x, y):
        return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))

    want = {(q, k, n) for q, v in rows[:200:50] for n, (_, k) in enumerate(sorted((-cos(v, w), k) for k, w in rows[:200])[:7], 1)}
    for block in (2048, 2):
        monkeypatch.setattr(search, "BLOCK", block)
        assert {(r.query, r.key, r["rank"]) for r in search.nearest(vectors, queries, 7).collect()} == want


def test_uuid5(spark):
    row = spark.range(1).select(scalars.association_weight(F.lit(1)).alias("w"), scalars.uuid5(str(uuid.NAMESPACE_URL), F.lit("a name")).alias("u")).first()
    assert row.w == pytest.approx(1 - math.exp(-0.2))
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "a name"))


def test_truncation_keeps_characters_whole(spark):
    texts = ["", "plain", "naïve café", "日本語のテキスト", "a😀b😀c", None]
    for most in range(0, 14):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.truncated(F.col("t"), most).alias("cut")).collect()
        for r in rows:
            assert r.cut == (None if r.t is None else r.t.encode()[:most].decode(errors="ignore"))


def test_websearch_alternatives():
    assert rules.websearch('red "big dog" -cat OR -"blue sky" x-y') == [(["red", "big dog"], ["cat"]), (["x y"], ["blue sky"])]
    assert rules.websearch(" OR ") == []


def test_hold_out_folds_the_whole_digest(spark):
    import hashlib

    rows = spark.range(50).select(F.col("id").cast("string").alias("k")).select("k", scalars.held_out(F.col("k")).alias("h")).collect()
    assert all(r.h == (int(hashlib.sha256(r.k.encode()).hexdigest(), 16) % 100 < 20) for r in rows)


def test_segments_by_hand(spark):
    rows = [(1, i, f"2024-01-01 {h:02d}:{m:02d}:00") for i, (h, m) in enumerate([(0, 0), (0, 1), (5, 0), (5, 1), (12, 0)])]
    events = spark.createDataFrame(rows, "u int, id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sessions.segments(events, "u", "ts", "id", "4 HOURS").groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in got] == [2, 2, 1]


def test_settle_stops_when_it_rests(spark):
    edges = spark.createDataFrame([("k", "m", 3.0), ("m", "n", 0.5), ("n", "o", 9.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "k", 1.0), (2, "alone", 1.0)], "query long, node string, mass double")
    found = graph.neighbourhood(edges, seeds, hops=2, cap=10)
    weights = {(r.src, r.dst): r.weight for r in found.collect()}
    # k-m is reached from both ends, m-n from one; o lies too far
    assert weights == {("k", "m"): pytest.approx(1.0), ("m", "k"): pytest.approx(6 / 6.5), ("m", "n"): pytest.approx(0.5 / 6.5), ("n", "m"): pytest.approx(0.5)}
    got = {(r["query"], r.node): r.activation for r in graph.settle(found, seeds, rounds=200).collect()}
    k = got[1, "k"]
    assert k == pytest.approx(0.3 + 0.7 * got[1, "m"] * 6 / 6.5, abs=1e-5) and got[1, "n"] == pytest.approx(0.7 * got[1, "m"] * 0.5 / 6.5, abs=1e-5)
    assert got[2, "alone"] == pytest.approx(0.3, abs=1e-5)
    assert {r.node for r in graph.expansion(graph.settle(found, seeds), seeds, 1).collect()} == {"m"}
    assert {r.dst for r in graph.neighbourhood(edges, seeds, hops=3, cap=2).collect()} == {"k", "m"}


def test_entropy_and_auc(spark):
    rows = spark.createDataFrame([(i % 4, i, int(i >= 4)) for i in range(8)], "b int, s int, y int")
    assert metrics.entropy(rows, "b").first().entropy == pytest.approx(2)
    assert metrics.auc(rows, "s", "y").first().auc == 1.0
    many = spark.range(3000).selectExpr("(id * 7919) % 1000 / 3.0 AS s", "cast(id % 3 = 0 as int) AS y")
    pos, neg = ([r.s for r in many.filter(f"y = {y}").collect()] for y in (1, 0))
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert metrics.auc(many, "s", "y").first().auc == pytest.approx(wins / len(pos) / len(neg))


def test_segments_keep_columns_of_other_names(spark):
    rows = spark.range(4).selectExpr("0 AS u", "id", "timestamp_seconds(id * 10000) AS ts", "1 AS _new", "2 AS _n")
    assert sessions.segments(rows, "u", "ts", "id", "1 HOUR").columns == ["u", "id", "ts", "_new", "_n", "segment"]
    assert sessions.latest(rows, ["u"], F.desc("id")).columns == rows.columns


def test_log_reader(spark, tmp_path):
    import datetime
    import os

    sid = "6f1c1f44-0000-4000-8000-00000000000a"
    said = lambda kind, content, **more: {"type": kind, "message": {"content": content}, **more}
    block = lambda kind, **more: {"type": kind, **more}
    main = [
        said("user", "[1, 2] isn't a list", sessionId=sid, cwd="", timestamp="2024-01-01T00:00:00Z"),
        said("user", [block("tool_result", content="out"), block("text", text="so"), block("image"), block("tool_result", content=[block("text", text="x\0y"), block("image"), block("text", text="z")]), block("odd")], sessionId=sid, cwd="/a"),
        said("assistant", [block("thinking", thinking="hm"), block("text", text=""), block("tool_use", name="ls", input={"b": 1, "a": [2]})], cwd="/b"),
        said("assistant", []),
        {"type": "system", "content": "kept as empty"},
        {"type": "summary"},
        {"type": "user"},
    ]
    child, loose = [said("user", "go", sessionId=sid)], [said("user", "p", sessionId="one"), said("user", "q", sessionId="two")]
    files = {"d/main.jsonl": main, f"d/{sid}/subagents/c.jsonl": child, "d/loose.jsonl": loose}
    for name, rows in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n\n")
        os.utime(tmp_path / name, (1_000_000, 1_000_000))
    events = jsonl.read_log(spark, str(tmp_path))
    got: dict = {}
    for r in events.orderBy("file", "pos", "n").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.type, r.text, r.ts.replace(tzinfo=datetime.UTC).timestamp()))
    day, late = 1_704_067_200, 1_000_000
    assert got == {
        "main.jsonl": [("user", "[1, 2] isn't a list", day), ("tool_result", "out", late), ("tool_result", "xy\nz", late + 1), ("user", "so\n[image]", late + 2), ("assistant", 'hm\n[tool_use:ls {"b":1,"a":[2]}]', late + 3), ("system", "", late + 4)],
        "c.jsonl": [("user", "go", late)],
        "loose.jsonl": [("user", "p", late), ("user", "q", late + 1)],
    }
    import hashlib

    raw = (tmp_path / "d/loose.jsonl").read_text().rstrip("\n") + "\n"
    want = {
        "main.jsonl": (sid, "/a", 6, True),
        "c.jsonl": (str(uuid.uuid5(uuid.UUID(sid), "subagents/c.jsonl")), None, 1, False),
        "loose.jsonl": (str(uuid.uuid5(uuid.NAMESPACE_OID, "loose.jsonl|" + hashlib.sha256(raw.encode()).hexdigest())), None, 2, True),
    }
    assert {r.file.rsplit("/", 1)[1]: (r.session_id, r.cwd, r.n, r.ended is not None) for r in jsonl.log_sessions(events).collect()} == want


def test_fold_stream_counts_once(spark, tmp_path):
    spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("src string, dst string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        fold_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r.src, r.n) for r in edges(spark, f"{tmp_path}/out", "string").read().collect()} == {("a", 2), ("b", 1)}


def test_budgets_against_a_plain_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(k, c, i, rng.randrange(1, 40)) for i in range(90) for k, c in [(rng.randrange(3), rng.choice("xyz"))]] + [(0, "x", 900, None)]
    items = spark.createDataFrame(rows, "k int, c string, i int, cost long")
    greedy, turns = set(), set()
    for k in range(3):
        own, left = sorted((r for r in rows if r[0] == k), key=lambda r: r[2]), 100
        for r in own:
            if r[3] is not None and r[3] <= left:
                left -= r[3]
                greedy.add(r[2])
        lists = {c: [r for r in own if r[1] == c] for c in "xyz"}
        order, left = sorted((c for c in lists if lists[c]), key=lambda c: lists[c][0][2]), 100
        for n in range(max(map(len, lists.values()))):
            for c in order:
                if n < len(lists[c]) and lists[c][n][3] is not None and lists[c][n][3] <= left:
                    left -= lists[c][n][3]
                    turns.add(lists[c][n][2])
    assert {r.i for r in memory.within_budget(items, "k", 100, ["i"]).collect()} == greedy
    assert {r.i for r in memory.round_robin(items, "k", "c", 100, ["i"]).collect()} == turns


def test_representatives_are_central_and_unlike(spark):
    rows = [(1, 1, [1.0, 0.1]), (1, 2, [1.0, 0.12]), (1, 3, [0.2, 1.0]), (1, 4, None), (2, 5, [3.0, 0.0])]
    got = memory.most_diverse(spark.createDataFrame(rows, "label int, vec_id int, embedding array<double>"), "label", 2, 2).collect()
    assert {(r.label, r.vec_id, r.place) for r in got} == {(1, 2, 1), (1, 3, 2), (2, 5, 1)}
