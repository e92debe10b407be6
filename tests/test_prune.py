"""Communities against every partition, and odd groups."""

import itertools

import pytest

from strandline.operators import graph, prune


def modularity(parts, edges):
    total = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    inside = lambda p: sum(w for a, b, w in edges if a in p and b in p)
    return sum(inside(p) / total - (sum(degree.get(x, 0) for x in p) / (2 * total)) ** 2 for p in parts)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [{items[0]}, *rest]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] | {items[0]}, *rest[i + 1 :]]


def test_communities_are_the_best_partition(spark):
    clique = lambda xs, w: [(a, b, w) for a, b in itertools.combinations(xs, 2)]
    graphs = {
        1: (range(7), [*clique(range(3), 1.0), *clique(range(3, 7), 0.5), (2, 3, 0.2)]),
        2: (range(6), [(0, 1, 2.0), (1, 0, 1.0), (2, 3, 0.5), (1, 2, 0.1), (4, 4, 9.0)]),
        3: (range(2), []),
    }
    nodes = spark.createDataFrame([(g, n) for g, (ns, _) in graphs.items() for n in [*ns, 0]] + [(3, None)], "g int, node int")
    links = [(g, *e) for g, (_, es) in graphs.items() for e in es] + [(9, 0, 1, 1.0), (3, 0, 77, 1.0)]
    got: dict = {}
    for r in prune.communities(nodes, spark.createDataFrame(links, "g int, src int, dst int, weight double"), "g", "node").collect():
        got.setdefault(r.g, {}).setdefault(r.community, set()).add(r.node)
    assert set(got) == {1, 2, 3} and got[3] == {0: {0}, 1: {1}}
    for g, (ns, es) in graphs.items():
        es = [e for e in es if e[0] != e[1]]
        assert all(name == min(part) for name, part in got[g].items())
        if es:
            best = max(modularity(p, es) for p in partitions(list(ns)))
            assert modularity(list(got[g].values()), es) == pytest.approx(best)


def test_surprise_of_odd_items(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "a", "b"]), (1, 2, ["b"]), (1, 3, []), (1, 4, None), (2, 1, [])], "g int, i int, w array<string>")
    got = {(r.g, r.i): r.score for r in prune.surprise(rows, "g", "i", "w").collect()}
    assert got[1, 1] > got[1, 2] > 0 and got[1, 3] == got[1, 4] == got[2, 1] == 0


def test_settle_refuses_odd_settings(spark):
    nothing = spark.createDataFrame([], "query int, src int, dst int, weight double")
    seeds = spark.createDataFrame([], "query int, node int, mass double")
    for odd in ({"damping": 1.0}, {"damping": -0.1}, {"rounds": 0}, {"eps": 0.0}):
        with pytest.raises(ValueError):
            graph.settle(nothing, seeds, **odd)
    for odd in ({"hops": -1}, {"cap": 0}):
        with pytest.raises(ValueError):
            graph.neighbourhood(nothing, seeds, **odd)
