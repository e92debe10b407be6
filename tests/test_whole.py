"""Recall stage by stage, with stages that fail, and turns that aren't the session's text."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import recall as recalls
from strandline.operators import turns
from strandline.operators.recall import Plan, recall

HITS = "query int, key long, score double"
A = [(1, 10, 0.9), (1, 11, 0.5), (1, 10, 0.2), (2, 12, 1.0)]
B = [(1, 11, 7.0), (1, 13, 3.0)]


def hits(spark, rows):
    return lambda: spark.createDataFrame(rows, HITS)


def got(df):
    return {(r.query, r.key): r for r in df.collect()}


def test_lists_are_fused_and_broken_ones_left_out(spark):
    def down():
        raise ConnectionError("no such tier")

    plan = Plan(limit=2)
    found = got(recall({"a": hits(spark, A), "down": down, "b": hits(spark, B)}, plan))
    assert list(plan.failed) == ["down"] and "no such tier" in plan.failed["down"]
    assert {k: r.place for k, r in found.items()} == {(1, 11): 1, (1, 10): 2, (2, 12): 1}
    assert found[1, 11].score == 1.0 and found[1, 10].score == pytest.approx((1 / 61) / (1 / 62 + 1 / 61), abs=1e-9)
    assert (found[1, 11].origin, found[1, 10].origin) == ("a", "a")
    with pytest.raises(RuntimeError, match="no list"):
        recall({"down": down}, Plan())
    late = hits(spark, A)().withColumn("score", F.expr("raise_error('broken row')").cast("double"))  # fails when it runs, not when it is made
    plan = Plan()
    assert recall({"a": lambda: late, "b": hits(spark, B)}, plan).count() == 2 and "a" in plan.failed


def test_rerank_and_its_failure(spark):
    texts = spark.createDataFrame([(10, "x"), (11, ""), (13, "yy")], "key long, text string")
    rerank = lambda pool: pool.select("query", "key", F.length("text").alias("score"))
    found = got(recall({"a": hits(spark, A), "b": hits(spark, B)}, Plan(rerank_weight=0.5), texts=texts, rerank=rerank))
    top = 1 / 62 + 1 / 61
    assert found[1, 13].score == pytest.approx(0.5 * (1 / 62) / top + 0.5, abs=1e-9) and found[1, 11].score == 1.0  # without a text the fused rank stays whole
    assert found[1, 10].score == pytest.approx(0.5 * (1 / 61) / top + 0.25, abs=1e-9)
    plan = Plan()
    plain = got(recall({"a": hits(spark, A), "b": hits(spark, B)}, plan, texts=texts, rerank=lambda pool: pool.select("nothing")))
    assert list(plan.failed) == ["rerank"] and plain[1, 10].place == 2


def test_expansion_adds_what_the_graph_activates(spark):
    edges = spark.createDataFrame([(10, 20, 0.9), (20, 21, 0.8), (10, 22, 0.5), (99, 98, 1.0)], "src long, dst long, weight double")
    texts = spark.createDataFrame([(10, "a"), (21, "b"), (22, "c")], "key long, text string")
    lists = {"a": hits(spark, [(1, 10, 1.0)])}
    off = got(recall(lists, Plan()))
    assert set(off) == {(1, 10)}
    every = got(recall(lists, Plan(settle="expand"), lambda: edges))
    assert set(every) == {(1, k) for k in (10, 20, 21, 22)} and every[1, 20].origin == "expansion" and every[1, 10].place == 1
    some = got(recall(lists, Plan(settle="channel", rerank_weight=0.3, activation_weight=0.3), lambda: edges, texts))
    assert set(some) == {(1, k) for k in (10, 21, 22)}  # 20 has no text, but what it passed on to 21 stays
    assert some[1, 21].score > 0 and some[1, 10].score == pytest.approx(1.3)
    plan = Plan(settle="expand")
    assert set(got(recall(lists, plan, lambda: edges.select("nothing")))) == {(1, 10)} and list(plan.failed) == ["settle"]


@pytest.mark.parametrize("bad", [{"settle": "on"}, {"rerank_weight": 0.8, "activation_weight": 0.3}, {"rerank_weight": -0.1}, {"limit": 0}])
def test_plans_are_checked(bad):
    with pytest.raises(ValueError):
        Plan(**bad)


def test_no_hits(spark):
    assert recall({"a": hits(spark, [])}, Plan(settle="expand"), lambda: spark.createDataFrame([], "src long, dst long, weight double")).collect() == []
    assert recalls.POOL == 50


TURNS = "session string, position int, role string, content string, char_start int, char_end int"


@pytest.mark.parametrize(
    "text,rows,errors",
    [
        ("hello you", [("user", "hello ", 0, 6), ("assistant", "you", 6, 9)], {}),
        ("é!", [("user", "é", 0, 2), ("user", "!", 2, 3)], {}),
        ("", [], {None: "no turns"}),
        ("ab", [("user", "a", -1, 1)], {0: "negative start -1", None: "text after the last turn: 1"}),
        ("ab", [("user", "", 0, 0), ("user", "ab", 0, 2)], {0: "empty span [0:0]"}),
        ("ab", [("user", "abc", 0, 3)], {0: "end 3 past the text's 2"}),
        ("ab", [("user", "ax", 0, 2)], {0: "content is not text[0:2]"}),
        ("ab", [("owner", "ab", 0, 2)], {0: "role owner"}),
        ("abc", [("user", "ab", 0, 2), ("user", "bc", 1, 3)], {1: "overlaps the turn before by 1"}),
        ("abc", [("user", "a", 0, 1), ("user", "c", 2, 3)], {1: "gap of 1"}),
        ("abc", [("user", "a", 0, 1)], {None: "text after the last turn: 2"}),
        ("ab", [("user", "ab", None, 2)], {0: "no position or span"}),
    ],
)
def test_turns_by_hand(spark, text, rows, errors):
    given = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], TURNS)
    sessions = spark.createDataFrame([("s", text), ("t", "x")], "session string, text string")
    other = spark.createDataFrame([("t", 0, "user", "x", 0, 1)], TURNS)
    found = {r.position: r.error for r in turns.turn_errors(sessions, given.unionByName(other)).collect()}
    assert found == errors
    good, kept = turns.whole(sessions, given.unionByName(other))
    assert {r.session for r in good.collect()} == ({"t"} if errors else {"s", "t"}) and kept.count() == 1 + (0 if errors else len(rows))


def test_turns_of_no_session_and_of_one_place(spark):
    rows = [("gone", 0, "user", "x", 0, 1), ("s", 0, "user", "a", 0, 1), ("s", 0, "user", "b", 1, 2)]
    found = sorted((r.session, r.error) for r in turns.turn_errors(spark.createDataFrame([("s", "ab")], "session string, text string"), spark.createDataFrame(rows, TURNS)).collect())
    assert found == [("gone", "no such session"), ("s", "position of another turn")]


@pytest.mark.parametrize("unit,width", [("bytes", 3), ("chars", 2)])
def test_offsets_count_their_unit(spark, unit, width):
    rows = spark.createDataFrame([("s", 1, "user", "é!"), ("s", 2, "user", None), ("s", 3, "tool", "z")], "session string, position int, role string, content string")
    placed = turns.offsets(rows, unit)
    assert [(r.char_start, r.char_end) for r in placed.orderBy("position").collect()] == [(0, width), (width, width), (width, width + 1)]
    whole = spark.createDataFrame([("s", "é!z")], "session string, text string")
    assert turns.turn_errors(whole, placed.filter("position <> 2"), unit).count() == 0
