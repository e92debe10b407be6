"""Density clusters against a hierarchy by brute force: every threshold, every component."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import density

SCHEMA = "space string, id long, embedding array<double>"


def brute(rows, least, samples):
    """Labels of one space's (id, vector) rows, top down: at each smaller distance the components that are left, and the stability of each."""
    n = len(rows)
    v = np.array([r[1] for r in rows], float)
    v = v / np.linalg.norm(v, axis=1, keepdims=True).clip(1e-12)
    d = np.round(np.clip(1 - v @ v.T, 0, 2), density.DIGITS)
    same = np.array([[a[1] == b[1] for b in rows] for a in rows])
    d[same] = 0
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(n - 1, samples)]
    w = np.maximum(np.maximum(core[:, None], core), d)
    levels = sorted({float(x) for x in w[np.triu_indices(n, 1)]})

    def parts(members, most):
        left, out = set(members), []
        while left:
            comp, todo = set(), [left.pop()]
            while todo:
                x = todo.pop()
                comp.add(x)
                near = {y for y in left if w[x, y] <= most}
                left -= near
                todo += near
            out.append(comp)
        return out

    def explore(members, birth, upto):
        """(stability, its own children's choice) of a cluster born at 1 / distance ``birth`` whose members hold together at levels[upto]."""
        stable, here = 0.0, set(members)
        for i in range(upto, -1, -1):
            lam = 1 / levels[i] if levels[i] > 0 else float("inf")
            below = parts(here, levels[i - 1]) if i else [{x} for x in here]
            big = [p for p in below if len(p) >= least]
            if len(big) == 1:
                gone = len(here) - len(big[0])
                stable += gone * (lam - birth) if gone else 0
                here = big[0]
                continue
            stable += len(here) * (lam - birth)
            score, chosen = 0.0, []
            for p in big:
                s, c = explore(p, lam, i - 1)
                score, chosen = score + s, chosen + c
            return (stable, [set(members)]) if stable >= score and birth > 0 else (score, chosen)
        raise AssertionError

    if n < least:
        return {r[0]: None for r in rows}
    _, chosen = explore(range(n), 0.0, len(levels) - 1)
    out = {r[0]: None for r in rows}
    for c in chosen:
        for x in c:
            out[rows[x][0]] = min(rows[y][0] for y in c)
    return out


def blobs(rng, sizes, dims=6, spread=0.15, noise=10):
    out = []
    for n in sizes:
        head = [rng.gauss(0, 1) for _ in range(dims)]
        out += [[x + rng.gauss(0, spread) for x in head] for _ in range(n)]
    return out + [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(noise)]


def spaces(seed):
    rng = random.Random(seed)
    out = {"three": blobs(rng, [20, 20, 20], noise=0), "noisy": blobs(rng, [12, 9, 5, 3], noise=12), "random": blobs(rng, [], noise=40), "tiny": blobs(rng, [2], noise=0), "one": blobs(rng, [1], noise=0)}
    copies = blobs(rng, [8, 8], noise=6)
    out["copies"] = copies + [copies[0]] * 5 + [copies[9]] * 2 + [copies[-1]] * 3
    return out


def frame(spark, groups):
    return spark.createDataFrame([(s, i, v) for s, vs in groups.items() for i, v in enumerate(vs)], SCHEMA)


@pytest.mark.parametrize("near,block,edges,least", [(16, 2048, 50_000, 3), (4, 9, 7, 4)])
def test_clusters_against_brute_force(spark, monkeypatch, near, block, edges, least):
    monkeypatch.setattr(density, "BLOCK_ROWS", block)
    monkeypatch.setattr(density, "LEVEL_EDGES", edges)
    groups = spaces(near)
    got = {(r.space, r.id): r.cluster for r in density.clusters(frame(spark, groups), "space", "id", min_size=least, near=near).collect()}
    for s, vs in groups.items():
        want = brute(list(enumerate(vs)), least, least)
        assert {i: got[s, i] for i in want} == want, s


def test_three_blobs(spark):
    rows = [("s", i, v) for i, v in enumerate(blobs(random.Random(0), [20, 20, 20], dims=128, spread=0.1, noise=0))]
    got = {r.id: r.cluster for r in density.clusters(spark.createDataFrame(rows, SCHEMA), "space", "id").collect()}
    assert got == {i: i // 20 * 20 for i in range(60)}


def test_one_blob_is_noise(spark):
    rows = [("s", i, [1.0, 0.001 * i, 0.0]) for i in range(9)]  # evenly spaced: no split anywhere
    assert {r.cluster for r in density.clusters(spark.createDataFrame(rows, SCHEMA), "space", "id").collect()} == {None}
    same = spark.createDataFrame([("s", i, [1.0, 2.0]) for i in range(50)], SCHEMA)
    assert [r.cluster for r in density.clusters(same, "space", "id").collect()] == [None] * 50


def test_odd_rows(spark):
    rng = random.Random(6)
    good = [("a", i, v) for i, v in enumerate(blobs(rng, [6, 6], noise=0))]
    odd = [("a", 100, None), ("a", 101, []), ("a", 102, [float("nan")] * 6), (None, 103, good[0][2]), ("a", None, good[0][2]), ("a", 0, good[0][2])]
    got = {r.id: r.cluster for r in density.clusters(spark.createDataFrame(good + odd, SCHEMA).withColumn("cluster", F.lit("x")), "space", "id").collect()}
    assert set(got) == {*range(12), 100, 101, 102} and {got[i] for i in (100, 101, 102)} == {None} and {got[i] for i in range(12)} == {0, 6}
    mixed = good + [("a", 200 + i, [1.0, 0.1 * i]) for i in range(3)] + [("a", 300, [0.0] * 6)]
    assert density.clusters(spark.createDataFrame(mixed, SCHEMA), "space", "id").count() == 16
    assert density.clusters(spark.createDataFrame([], SCHEMA), "space", "id").count() == 0
    with pytest.raises(ValueError):
        density.clusters(spark.createDataFrame([], SCHEMA), "space", "id", min_size=1)
