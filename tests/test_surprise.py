"""Lift curves and codebooks against plain loops, and odd rows."""

import math
import random

import numpy as np
import pytest

from strandline.operators import codebook, metrics


def plain_lift(rows, budgets):
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    every = sum(r[2] == 1 for r in rows)
    for b in budgets:
        kept = math.floor(round(len(rows) * b, 9))
        hits = sum(r[2] == 1 for r in rows[:kept])
        yield b, kept, hits, hits / every if every else None, hits / every / b if every else None


@pytest.mark.parametrize("scores", ["many ties", "one value", "all different"])
def test_lift_is_exact(spark, scores):
    rng = random.Random(scores)
    value = {"many ties": lambda i: float(rng.randrange(5)), "one value": lambda i: 1.0, "all different": lambda i: rng.random()}[scores]
    rows = [(i, None if i % 17 == 0 else value(i), rng.choice([0, 0, 1, None])) for i in range(300)]
    budgets = (0.1, 0.29, 0.5, 0.75, 1.0)
    got = metrics.lift(spark.createDataFrame(rows, "id int, score double, hit int"), "score", "hit", "id", budgets).orderBy("budget").collect()
    for g, w in zip(got, plain_lift(rows, budgets), strict=True):
        assert tuple(g)[:3] == w[:3] and tuple(g)[3:] == pytest.approx(w[3:])


def test_lift_of_odd_tables(spark):
    none = spark.createDataFrame([(1, 2.0, 0), (2, None, 1)], "place int, s double, p int")  # names that clash
    assert [tuple(r) for r in metrics.lift(none, "s", "p", "place", (1.0,)).collect()] == [(1.0, 1, 0, None, None)]
    assert [tuple(r) for r in metrics.lift(none.filter("false"), "s", "p", "place", (0.5,)).collect()] == [(0.5, 0, 0, None, None)]
    with pytest.raises(ValueError):
        metrics.lift(none, "s", "p", "place", (0.0,))
    assert [tuple(r)[2:] for r in metrics.rank_sums(none, "s", "p").collect()] == [(None,) * 4]
    got = metrics.rank_sums(spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 1), (2.0, 0)], "s double, p int"), "s", "p").collect()[0]
    assert (got.u_pos, got.u_neg) == (3.5, 0.5) and got.z == pytest.approx(1.5 / math.sqrt(4 * 5 / 12))


def test_codebook_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    vecs = np.concatenate([c + 0.05 * rng.normal(size=(25, 6)) for c in centres])[rng.permutation(100)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id int, embedding array<double>").repartition(5)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    books = unit[:6].copy()
    for _ in range(50):
        at = (unit @ books.T).argmax(axis=1)
        for c in set(at.tolist()):
            mean = unit[at == c].sum(axis=0)
            books[c] = mean / np.linalg.norm(mean)
    got = codebook.fit(rows, 6)
    assert np.allclose(got, books)
    far = {r.vec_id: (r.cell, r.residual) for r in codebook.residuals(rows, got).collect()}
    at = (unit @ books.T).argmax(axis=1)
    assert all(far[i][0] == at[i] and far[i][1] == pytest.approx(1 - (unit[i] @ books.T).max(), abs=1e-9) for i in range(100))


def test_codebook_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0])], "vec_id int, embedding array<double>")
    books = codebook.fit(rows, 3)
    assert np.allclose(books, [[1, 0], [0, 1]])
    got = {r.vec_id: r.cell for r in codebook.residuals(rows, books).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, None: 0}
    nothing = codebook.fit(rows.filter("false"), 3)
    assert len(nothing) == 0 and codebook.residuals(rows.limit(2), nothing).filter("cell IS NULL").count() == 2
    with pytest.raises(ValueError):
        codebook.fit(rows, 0)
