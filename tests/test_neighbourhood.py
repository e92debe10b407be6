"""Neighbourhoods whose room is used up, and settling."""

from strandline.operators import graph


def test_full_queries_are_joined_no_further(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or cut(df))
    edges = spark.createDataFrame([(0, i, 1.0 / i) for i in range(1, 6)] + [(i, 10 * i, 0.5) for i in range(1, 6)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([("full", 0), ("open", 50)], "query string, node long")
    found = graph.neighbourhood(edges, seeds, 2, 4)
    nodes = {(r["query"], r[end]) for r in found.collect() for end in ("src", "dst")}
    assert nodes == {("full", n) for n in (0, 1, 2, 3)} | {("open", n) for n in (50, 5, 0)}
    for plan in plans[1:]:  # each hop leaves out queries without room
        assert "room" in plan and "> cast(0 as bigint)" in plan


def test_settle_with_text_names_and_a_seed_alone(spark):
    edges = spark.createDataFrame([("q", "a", "b", 1.0), ("q", "b", "a", 1.0)], "query string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("q", "a", 1.0), ("alone", "z", 1.0)], "query string, node string, mass double")
    got = {(r["query"], r["node"]): r["activation"] for r in graph.settle(edges, seeds, damping=0.5, eps=1e-12, rounds=100).collect()}
    assert abs(got["q", "a"] - 2 / 3) < 1e-9 and abs(got["q", "b"] - 1 / 3) < 1e-9 and abs(got["alone", "z"] - 0.5) < 1e-9
