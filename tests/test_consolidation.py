"""Consolidation, text rules and SQL functions on odd rows and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import rules
from strandline.operators import consolidate


def test_clusters_one_after_another(spark):
    rng = random.Random(4)
    known, clusters = [], []
    for space in range(6):
        known += [(space, f"m{i}", sorted(rng.sample(range(40), rng.randint(1, 8))), rng.choice([0.5, 0.97])) for i in range(5)]
        clusters += [(space, rng.sample(range(40), rng.randint(0, 8))) for _ in range(7)]
        clusters.append((space, known[-1][2]))
    clusters += [(9, [3, 1]), (9, None), (9, [1, 3])]
    got = consolidate.apply_clusters(spark.createDataFrame(known, "space int, id string, members array<bigint>, confidence double"), spark.createDataFrame(clusters, "space int, members array<bigint>"))
    want = {(s, i): [set(m), c, False] for s, i, m, c in known}
    for space in {s for s, _ in clusters}:
        for members in sorted((set(m) for s, m in clusters if s == space and m), key=min):
            overlap = sorted((-len(members & v[0]), i) for (s, i), v in want.items() if s == space and members & v[0])
            if not overlap:
                want[space, f"new-{min(members)}"] = [members, 0.5, True]
            elif want[space, overlap[0][1]][0] != members:
                was = want[space, overlap[0][1]]
                want[space, overlap[0][1]] = [members, min(0.99, was[1] + 0.05), True]
    assert {(r.space, r.id): [set(r.members), pytest.approx(r.confidence), r.written] for r in got.collect()} == want


def test_names_and_entities(spark):
    cases = {
        "The dog saw Mira. Then Jo Park left": ["jo park", "mira. then jo park"][1:],
        "Hello there": [],
        "go to Oslo now, NASA said": ["oslo"],
        "call `do it` or \"Do That\" with snake_case, kebab-like and @me": ["@me", "do it", "do that", "kebab-like", "snake_case", '"do that"'],
        "a MixedCase word": ["mixedcase"],
        "": [],
        None: [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", rules.entities(F.col("t")).alias("e")).collect()
    assert {r.i: r.e for r in rows} == {i: sorted(v) for i, v in enumerate(cases.values())}


def test_facts_of_odd_answers(spark):
    cases = {'{"facts": ["a", "b"]}': "- a\n- b", '{"facts": []}': "", ' {"facts": [1]} ': '{"facts": [1]}', '{"facts": [null]}': '{"facts": [null]}', " plain ": "plain", '["a"]': '["a"]', '{"facts": "a"}': '{"facts": "a"}', None: None}
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", rules.facts(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == cases


def test_modules(spark):
    cases = {"": ".", "x.py": ".", "a/x.py": "a", "a/b/x.py": "a/b", "a/b/c": "a/b/c", "a/b/Makefile": "a/b", "/a/b/c/d.py": "a/b/c", "./a/b": "a", None: "."}
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", rules.module(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == cases


def test_contradictions_with_copies_and_other_columns(spark):
    memories = spark.createDataFrame([(1, 0.5, "x"), (2, 0.5, "y")], "id int, confidence double, hits string")
    edges = spark.createDataFrame([(1, 2, "supports", 0.4), (2, 1, "hebbian", 0.6), (1, 3, "supports", 0.7)], "src int, dst int, kind string, weight double")
    after, new = consolidate.contradicted(memories, edges, spark.createDataFrame([(1, 2), (1, 2)], "old int, new int"))
    assert {r.id: round(r.confidence, 4) for r in after.collect()} == {1: 0.12, 2: 0.5}
    assert {(r.src, r.dst, r.kind): round(r.weight, 3) for r in new.collect()} == {(1, 2, "supports"): 0.04, (2, 1, "hebbian"): 0.06, (1, 3, "supports"): 0.7, (2, 1, "contradicts"): 1.0}
