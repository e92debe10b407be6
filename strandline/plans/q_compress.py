"""Queries of compressors: each conversation is a question (its first turn) with sessions of three turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.compress import bm25, compress

from .registry import query, table

_T = "t AS (SELECT conv_id AS query, turn // 3 AS session, turn, coalesce(text, '') AS text, length(coalesce(text, '')) // 4 AS cost, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM conversations)"


def _rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    turns = rows.select(F.col("conv_id").alias("query"), F.expr("turn div 3").alias("session"), "turn", "text")
    return turns, rows.groupBy(F.col("conv_id").alias("query")).agg(F.min_by("text", "turn").alias("question"))


def _kept(spark, sf_dir, name, budget, scorer=None):
    return compress(name, *_rows(spark, sf_dir), budget, scorer).select("query", "session", "turn")


@query("ml22_topk_sessions", f"WITH {_T}, s AS (SELECT query, session, sum(sum(cost)) OVER (PARTITION BY query ORDER BY session) AS upto FROM t GROUP BY query, session) SELECT query, session, turn FROM t JOIN s USING (query, session) WHERE upto <= 120")
def topk_sessions(spark, sf_dir):
    return _kept(spark, sf_dir, "topk_sessions", 120)


@query(
    "ml22_lexical_relevance",
    f"""WITH RECURSIVE {_T}, q AS (SELECT query, unnest(list_distinct(arg_min(w, turn))) AS term FROM t GROUP BY query), c AS (SELECT query, count(*) AS n, avg(len(w)) AS mean FROM t GROUP BY query),
x AS (SELECT query, turn, len(w) AS size, unnest(w) AS term FROM t), f AS (SELECT query, turn, size, term, count(*) AS tf FROM x JOIN q USING (query, term) GROUP BY ALL), d AS (SELECT query, term, count(*) AS df FROM f GROUP BY ALL),
b AS (SELECT query, turn, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM f JOIN d USING (query, term) JOIN c USING (query) GROUP BY ALL),
o AS (SELECT t.*, row_number() OVER (PARTITION BY query ORDER BY round(coalesce(score, 0), 9) DESC, session, turn) AS place FROM t LEFT JOIN b USING (query, turn)),
r AS (SELECT query, session, turn, place, cost <= 60 AS kept, 60 - CASE WHEN cost <= 60 THEN cost ELSE 0 END AS room FROM o WHERE place = 1 UNION ALL SELECT o.query, o.session, o.turn, o.place, o.cost <= r.room, r.room - CASE WHEN o.cost <= r.room THEN o.cost ELSE 0 END FROM r JOIN o ON o.query = r.query AND o.place = r.place + 1)
SELECT query, session, turn FROM r WHERE kept""",
)
def lexical_relevance(spark, sf_dir):
    return _kept(spark, sf_dir, "lexical_relevance", 60)


@query("ml22_relevance_expanded")
def relevance_expanded(spark, sf_dir):
    """The best turns by their question's words, with neighbours in the same session."""
    return _kept(spark, sf_dir, "extractive_relevance_expanded", 60, bm25)
