"""Compressors by name against plain loops."""

import math
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import compress

TURNS = [
    (1, 0, 0, "the river rose over the old mill"), (1, 0, 1, "a mill by the river"), (1, 0, 2, "nobody came"), (1, 1, 0, "bread and salt and wine"),
    (1, 1, 1, None), (1, 1, 2, "wine from the old cellar by the river, a long story of it"), (1, 2, 0, "nobody came again"), (2, 0, 0, "lone words"), (2, 0, 1, ""),
]


def plain(name, question, turns, budget, score):
    cost = lambda t: len(t[3] or "") // 4
    key = lambda t: t[1:3]

    def greedy(rows, room):
        kept = []
        for t in rows:
            if cost(t) <= room:
                room -= cost(t)
                kept.append(t)
        return kept, room

    if name == "topk_sessions":
        kept, room = [], budget
        for s in sorted({t[1] for t in turns}):
            own = [t for t in turns if t[1] == s]
            room -= sum(map(cost, own))
            if room < 0:
                break
            kept += own
        return set(map(key, kept))
    if name == "lexical_relevance":
        words = {key(t): re.findall("[a-z0-9]+", (t[3] or "").lower()) for t in turns}
        mean = sum(map(len, words.values())) / len(words)
        def score(t):
            total = 0.0
            for q in set(re.findall("[a-z0-9]+", question)):
                df, tf = sum(q in w for w in words.values()), words[key(t)].count(q)
                total += math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[key(t)]) / mean)) if tf else 0
            return total
    rows = sorted(turns, key=lambda t: (-round(score(t), 9), key(t)))
    if name != "extractive_relevance_expanded":
        return set(map(key, greedy(rows, budget)[0]))
    kept, _ = greedy(rows, int(budget * 0.7 + 1e-9))
    room, out = budget - sum(map(cost, kept)), set(map(key, kept))
    by = {key(t): t for t in turns}
    for s, n in sorted(out):
        for other in ((s, n - 1), (s, n + 1)):
            if other in by and other not in out and cost(by[other]) <= room:
                room -= cost(by[other])
                out.add(other)
    return out


@pytest.mark.parametrize("name", ["topk_sessions", "lexical_relevance", "extractive_relevance", "extractive_relevance_expanded"])
def test_is_the_plain_loop(spark, name):
    turns = spark.createDataFrame(TURNS, "query int, session int, turn int, text string")
    asked = spark.createDataFrame([(1, "old wine, old river"), (2, None)], "query int, question string")
    score = lambda t: float(len(t[3] or "") % 7)
    scorer = lambda rows, _: rows.select("query", "session", "turn", (F.length(F.coalesce("text", F.lit(""))) % 7).alias("score"))
    for budget in (0, 9, 14, 20, 100):
        got: dict = {1: set(), 2: set()}
        for r in compress.compress(name, turns, asked, budget, scorer).collect():
            got[r.query].add((r.session, r.turn))
        for q, question in ((1, "old wine, old river"), (2, "")):
            assert got[q] == plain(name, question, [t for t in TURNS if t[0] == q], budget, score), (q, budget)


def test_all_names_keep_budgets_and_refuse_others(spark):
    turns = spark.createDataFrame(TURNS, "query int, session int, turn int, text string")
    asked = spark.createDataFrame([(1, "old wine")], "query int, question string")
    scorer = lambda rows, _: rows.limit(0).select("query", "session", "turn", F.lit(1.0).alias("score"))
    for name in compress.COMPRESSORS:
        rows = compress.compress(name, turns, asked, 12, scorer).collect()
        per = {q: sum(len(r.text) // 4 for r in rows if r.query == q) for q in (1, 2)}
        assert name == "full" or max(per.values()) <= 12, name
        assert compress.compress(name, turns, asked, None).count() == len(TURNS)
        assert compress.compress(name, turns.filter("false"), asked, 12, scorer).collect() == []
    with pytest.raises(KeyError, match="lexical_relevance"):
        compress.compress("lexical", turns, asked, 12)
    with pytest.raises(ValueError):
        compress.compress("extractive_relevance", turns, asked, 12)
    with pytest.raises(ValueError):
        compress.compress("full", turns, asked, -1)
