"""Queries that the fourth review found to skip work or to be too large, each on small tables."""

import os
import random
import sys
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.operators import communities, lineage, postings, search, text_scan, vector_index
from strandline.plans import q_bundles
from strandline.plans.registry import QUERIES

from test_findings_r03 import DOCS, VECTORS, many, plan_of, same


def settled(edges, seed, rounds=20):
    """Activation of all nodes within two links of a seed, by plain loops."""
    links = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    hop = {seed: 0}
    for h in (1, 2):
        for a in [n for n in hop if hop[n] == h - 1]:
            for b in links[a]:
                hop.setdefault(b, h)
    times = lambda a, b: (hop[a] < 2) + (hop[b] < 2) - (hop[a] == hop[b] < 2)
    own = {a: {b: w * times(a, b) for b, w in links[a].items() if b in hop} for a in hop}
    now = {n: float(n == seed) for n in hop}
    for _ in range(rounds):
        then = {n: 0.3 * (n == seed) for n in hop}
        for a in hop:
            for b, w in own[a].items():
                then[b] += 0.7 * now[a] * w / max(1.0, sum(own[a].values()))
        moved, now = sum(abs(then[n] - now[n]) for n in hop), then
        if moved < 1e-6:
            break
    return now


def test_f13_all_partners_count(spark, tmp_path):
    rng = random.Random(4)
    orders = [[50, i] for i in range(100, 180)] + [[rng.randrange(100, 180), 300 + i % 40] for i in range(400)] + [[50, 179]] * 2 + [[7, 8, 100]]
    rows = [(o, p, n) for o, parts in enumerate(orders) for n, p in enumerate(parts)]
    keys = [50, 100, 7, 8, *range(101, 180), *range(300, 340), 1000]  # 1000 has no partner
    part = ("p_partkey long, p_name string", [(k, f"n{k}") for k in keys])
    got = same(spark, tmp_path, "ml07_expansion", files=2, lineitem=("l_orderkey long, l_partkey long, l_linenumber int", rows), part=part)
    counts = defaultdict(int)
    for parts in orders:
        for i, a in enumerate(parts):
            for b in parts[i + 1 :]:
                counts[a, b] += a != b
    edges = [(a, b, 1 - np.exp(-n / 5)) for (a, b), n in counts.items() if n]
    for seed in (50, 100, 300):
        act = settled(edges, seed)
        best = sorted((-round(x, 8), n) for n, x in act.items() if n != seed)[:10]
        assert [n for _, n in best] == [n for _, n in sorted((r[3], r[1]) for r in got if r[0] == seed)]  # before: of the sixty first nodes only
    assert len(settled(edges, 50)) > 100 and not [r for r in got if r[0] == 1000]


def test_f4_links_of_a_node_are_added_up_at_once():
    rng = random.Random(1)
    n = 150
    links = [(a, b, 5.0 if a // 50 == b // 50 else rng.choice([0.5, 1.0])) for a in range(n) for b in range(n) if a != b]
    links = [(a, b, w if a < b else next(x[2] for x in links[b * (n - 1) : (b + 1) * (n - 1)] if x[1] == a)) for a, b, w in links]
    k = np.bincount([a for a, _, _ in links], [w for _, _, w in links]).tolist()
    columns = [*range(n), *(a for a, _, _ in links)], [None] * n + [b for _, b, _ in links], k + [w for _, _, w in links], [sum(k)] * n + [None] * len(links), [*range(n)] + [None] * len(links)
    rows = pa.table(dict(zip(("a", "b", "w", "m2", "comm"), columns, strict=True)))
    lines = Counter()

    def trace(frame, event, _):
        lines[event] += os.path.basename(frame.f_code.co_filename).endswith("communities.py")
        return trace

    was = sys.gettrace()
    sys.settrace(trace)
    try:
        found = communities._solved(rows, 1)
    finally:
        sys.settrace(was)
    assert found == [i // 50 * 50 for i in range(n)]
    assert lines["line"] < 10 * len(links)  # before: each move went through a node's links one by one


SAYINGS = ["a", "a b", '"a b" c', "a OR b c", "a -b", '"b a" OR "c d" OR e', "a a b", "zz", "a zz", "-a", "", 'running OR "the dogs"', "run dog", '"dogs the run"', "running run", "the", None]


@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_f2_f3_f11_a_scan_ranks_as_an_index_does(spark, tmp_path, monkeypatch, analyzer):
    rng = random.Random(7)
    words = "a b c d e the run running dogs dog or".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(250 if i % 9 == 0 else 25))), rng.choice(["a dogs", "en", None])) for i in range(90)] + [(None, "a b c", "a"), (500, None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    said = spark.createDataFrame([(i % 20 if i < 25 else None, SAYINGS[i % len(SAYINGS)]) for i in range(30)], "query long, said string")
    monkeypatch.setattr(text_scan, "HELD", 50)
    monkeypatch.setattr(text_scan, "SAID", 6)
    for n, fields in enumerate(({"text": "D"}, {"lang": "A", "text": "B"})):
        postings.build(table, f"{tmp_path}/{n}", fields=fields, analyzer=analyzer)
        want = postings.text_ranks(spark, f"{tmp_path}/{n}", said, analyzer).collect()
        got = text_scan.text_ranks(table, said, fields=fields, analyzer=analyzer).collect()
        rounded = lambda rows: sorted((r.query, r.key, round(r.dense, 9), round(r.rank_plain, 9)) for r in rows)
        assert rounded(got) == rounded(want) and len(got) > 300
    with pytest.raises(ValueError):
        text_scan.text_ranks(table.union(table), said)


@pytest.mark.parametrize("name", ["fn05_cover_density", "fn07_weighted_rank", "fn05_english"])
def test_f2_f3_f11_no_index_is_written(spark, monkeypatch, name):
    monkeypatch.setattr(postings, "build", lambda *_, **__: pytest.fail("written"))
    assert "hashpartitioning" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_f9_f10_a_query_is_sent_once_for_all_lists(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6 if i % 50 else 5)]) for i in range(400)] + [(900, None), (901, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id < 70 OR vec_id >= 900").selectExpr("vec_id % 60 AS query", "embedding AS vec")  # some names twice
    vector_index.build(vectors, f"{tmp_path}/i", cells=20)
    sent, was = [], vector_index.best_rows

    def best_rows(scan, targets, k, kind, *read):
        sent.append(sum(u.size for _, u in targets.values()) + sum(r[1].size for r in read if r))
        return was(scan, targets, k, kind, *read)

    monkeypatch.setattr(vector_index, "best_rows", best_rows)
    plain = lambda df: sorted((r["query"], r["key"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert plain(vector_index.search(spark, f"{tmp_path}/i", asked, 4, probes=20)) == plain(search.nearest(vectors, asked, 4))
    assert len(vector_index.search(spark, f"{tmp_path}/i", asked, 4, probes=5).collect()) > 200
    assert max(sent) <= 70 * 6  # before: once for each list it reads


def test_f5_f6_scores_are_made_once_more_only(spark, tmp_path):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(120)]
    tables = {"documents": (DOCS, many(60)), "embeddings": (VECTORS, vectors)}
    for name in ("agg12_max_normalised", "agg13_seed_mass"):
        assert same(spark, tmp_path, name, files=2, **tables)
        assert plan_of(QUERIES[name](spark, str(tmp_path))).count("MapInArrow") == 1  # before: one for the maxima, one for the rows, and more


def test_f8_only_some_pairs(spark):
    docs = spark.createDataFrame(many(60), DOCS).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    asked = docs.filter("doc_id IN ('d0', 'd7', 'd50')").selectExpr("doc_id AS query", "explode(split(text, ' ')) AS term")
    rows = [(r["query"], r["key"], r["score"]) for r in search.bm25(docs, asked).collect()]
    some = {(q, k) for q, k, _ in rows[::7]}
    only = spark.createDataFrame([*some, ("d0", "none"), ("other", "d1"), ("d50", "d9")], "query string, key string")
    got = search.bm25(docs, asked, only=only).collect()
    assert {(r["query"], r["key"], r["score"]) for r in got} == {r for r in rows if r[:2] in some | {("d50", "d9")}} and len(got) >= len(some) > 5


def test_f12_bundles_and_tables_go_once_they_are_read(spark, tmp_path, monkeypatch):
    for module in (lineage, q_bundles):
        monkeypatch.setattr(module, "scratch", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    assert len(QUERIES["src15_import_runs"](spark, "/root/testdata/sf0.001").collect()) == 3
    assert list(tmp_path.glob("[!.]*")) == []  # before: both sets of bundles, three runs' tables and the import
