"""Compressors by name: which turns of each question's sessions are kept within a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import tokens

from . import consolidate, memory, prune
from .communities import leiden
from .lineage import cut

#: Columns of turns; their order within a question.
TURN, ORDER = ["query", "session", "turn", "text"], ["session", "turn"]
#: Part of a budget that is kept back for neighbours.
RESERVE = 0.3

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
Compressor = Callable[[DataFrame, DataFrame, int, Scorer | None], DataFrame]
COMPRESSORS: dict[str, Compressor] = {}


def compressor(name: str) -> Callable[[Compressor], Compressor]:
    """Registers a compressor."""

    def register(f: Compressor) -> Compressor:
        if name in COMPRESSORS:
            raise ValueError(f"two compressors named {name}")
        COMPRESSORS[name] = f
        return f

    return register


def compress(name: str, turns: DataFrame, asked: DataFrame, budget: int | None, scorer: Scorer | None = None) -> DataFrame:
    """``query, session, turn, text`` of the turns that a compressor keeps for each question; without a budget all of them.

    ``turns`` are ``query, session, turn, text``, one row a turn, ``asked`` are ``query, question``. A turn costs a quarter of its characters, rounded down; null texts are empty. A
    ``scorer`` gives ``query, session, turn, score`` from turns and questions; turns without a score have 0. An unknown name is a ``KeyError`` that lists the known ones.
    """
    if name not in COMPRESSORS:
        raise KeyError(f"unknown compressor {name!r}; known: {sorted(COMPRESSORS)}")
    rows = turns.select(*TURN[:3], F.coalesce("text", F.lit("")).alias("text"))
    if budget is None:
        return rows
    if budget < 0:
        raise ValueError("a budget must be 0 or more")
    return COMPRESSORS[name](rows.withColumn("cost", F.floor(F.length("text") / 4)), asked, budget, scorer).select(*TURN)


def bm25(turns: DataFrame, asked: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query, session, turn, score`` of turns that have words of their question, the question's turns being the corpus; a word asked twice counts once."""
    words = turns.select(*TURN[:3], tokens(F.col("text")).alias("w"))
    corpus = words.groupBy("query").agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_length"))
    terms = asked.select("query", F.array_distinct(tokens(F.col("question"))).alias("q")).filter("size(q) > 0")
    own = turns.select(*TURN[:3], "text").join(terms, "query").select(*TURN[:3], "q", tokens(F.col("text")).alias("w"))  # only words that are asked for are rows
    found = own.select(*TURN[:3], F.size("w").alias("length"), F.explode(F.filter("w", lambda x: F.array_contains("q", x))).alias("term")).groupBy(*TURN[:3], "length", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("query", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return found.join(df, ["query", "term"]).join(corpus, "query").groupBy(*TURN[:3]).agg(F.sum(part).alias("score"))


def _scored(turns: DataFrame, scores: DataFrame) -> DataFrame:
    """Turns with ``less``: their score negated, rounded so that sums in another order tie alike."""
    own = scores.select(*TURN[:3], F.col("score").cast("double").alias("score"))
    return turns.join(own, TURN[:3], "left").withColumn("less", -F.round(F.coalesce("score", F.lit(0.0)), 9)).drop("score")


def _by(scorer: Scorer | None, turns: DataFrame, asked: DataFrame) -> DataFrame:
    if scorer is None:
        raise ValueError("this compressor needs a scorer")
    return _scored(turns, scorer(turns.select(*TURN), asked))


def _best(scored: DataFrame, budget: int) -> DataFrame:
    return memory.within_budget(scored, "query", budget, ["less", *ORDER])


@compressor("full")
def _full(turns, asked, budget, scorer):
    return turns


def _before(cost: Column) -> Column:
    return F.coalesce(F.sum(cost).over(Window.partitionBy("query").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


@compressor("truncate_tokens")
def _truncate_tokens(turns, asked, budget, scorer):
    """From the start, the turn that crosses the limit cut."""
    rows = turns.withColumn("room", 4 * budget - _before(F.length("text"))).filter("room > 0")
    return rows.withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("room").cast("int")))


@compressor("topk_sessions")
def _topk_sessions(turns, asked, budget, scorer):
    """Whole sessions from the first, up to the first that doesn't fit."""
    whole = turns.groupBy("query", "session").agg(F.sum("cost").alias("cost"))
    upto = F.sum("cost").over(Window.partitionBy("query").orderBy("session"))
    return turns.join(whole.withColumn("upto", upto).filter(F.col("upto") <= budget).select("query", "session"), ["query", "session"], "left_semi")


@compressor("extractive_relevance")
def _extractive_relevance(turns, asked, budget, scorer):
    """The best by score that fit; what doesn't fit is passed over."""
    return _best(_by(scorer, turns, asked), budget)


@compressor("extractive_relevance_expanded")
def _extractive_relevance_expanded(turns, asked, budget, scorer):
    """The best that fit a part of the budget, then in order of time the turns before and after them that fit the rest."""
    first = cut(_best(_by(scorer, turns, asked), int(budget * (1 - RESERVE) + 1e-9)))  # read three times
    near = first.select("query", "session", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn")).distinct()
    more = turns.join(near, TURN[:3], "left_semi").join(first.select(*TURN[:3]), TURN[:3], "left_anti")
    rows = first.select(*TURN, "cost", F.lit(0).alias("phase")).unionByName(more.select(*TURN, "cost", F.lit(1).alias("phase")))
    return memory.within_budget(rows, "query", budget, ["phase", *ORDER])


@compressor("lexical_relevance")
def _lexical_relevance(turns, asked, budget, scorer):
    """The best by the question's words."""
    return _best(_scored(turns, bm25(turns, asked)), budget)


def _surprising(turns: DataFrame) -> DataFrame:
    items = turns.select("query", F.struct("session", "turn").alias("item"), tokens(F.col("text")).alias("w"))
    return _scored(turns, prune.surprise(items, "query", "item", "w").select("query", "item.session", "item.turn", "score"))


@compressor("statistical_prune")
def _statistical_prune(turns, asked, budget, scorer):
    """The most surprising among the question's turns."""
    return _best(_surprising(turns), budget)


@compressor("graph_community")
def _graph_community(turns, asked, budget, scorer):
    """One of each community of words shared in turn, the most surprising (or best by the scorer) first."""
    numbers = turns.select(*TURN[:3], F.row_number().over(Window.partitionBy("query").orderBy(*ORDER)).alias("item"))
    items = turns.join(numbers, TURN[:3]).select("query", "item", tokens(F.col("text")).alias("w"))
    found = leiden(items, consolidate.jaccard_graph(items, "query", "item", "w"), "query", "item")
    scored = _surprising(turns) if scorer is None else _by(scorer, turns, asked)
    rows = scored.join(numbers.join(found, ["query", "item"]).select(*TURN[:3], "community"), TURN[:3])
    return memory.round_robin(rows, "query", "community", budget, ["less", *ORDER])
