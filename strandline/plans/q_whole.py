"""Recall and stored sessions as whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.text import chunks
from strandline.operators import recall as recalls
from strandline.operators import turns

from .q_consolidation import _CHUNKS
from .q_recall import _LISTS, _TOK, _vector
from .q_text import keyword_indexed
from .registry import query, table

_SCORED = f"""p AS (SELECT * FROM (SELECT query, key, sum(1.0 / (60 + rank)) AS rrf, min(tier) AS tier FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(rrf, 9) DESC, key) <= 50),
w AS (SELECT doc_id AS query, list_distinct({_TOK}[1:20]) AS q FROM documents WHERE doc_id % 50 = 0), c AS (SELECT key, {_TOK} AS t FROM ({_CHUNKS})),
s AS (SELECT query, key, max(len(list_intersect(q, t)) / greatest(len(q), 1)) AS rerank FROM p JOIN w USING (query) JOIN c USING (key) GROUP BY ALL),
a AS (SELECT query, key, tier, rrf, rerank, max(rrf) OVER o AS x, max(rerank) OVER o AS y, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 9) DESC, key) AS spot FROM p LEFT JOIN s USING (query, key) WINDOW o AS (PARTITION BY query)),
f AS (SELECT *, round(CASE WHEN rerank IS NULL THEN rrf / x ELSE 0.5 * rrf / x + 0.5 * rerank / CASE WHEN y > 0 THEN y ELSE 1 END END, 9) AS score FROM a)"""


@query("ml01_recall", f"WITH {_LISTS}, {_SCORED} SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, spot) AS place, CASE tier WHEN 1 THEN 'vector' ELSE 'keyword' END AS origin FROM f QUALIFY place <= 10")
def recall(spark, sf_dir):
    """Every fiftieth document's vector and keyword lists, fused, a pool of fifty reranked by the best chunk's share of the query's words, the ten best; a third list is down."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.array_distinct(F.slice(scalars.tokens(F.col("text")), 1, 20)).alias("q"))

    def down():
        raise ConnectionError("this tier is down")

    def rerank(pool):
        parts = pool.select("query", "key", F.explode(F.transform(chunks(F.col("text")), scalars.tokens)).alias("t")).join(asked, "query")
        return parts.select("query", "key", (F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1))).alias("score"))

    texts = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lists = {"vector": lambda: _vector(spark, sf_dir), "keyword": lambda: keyword_indexed(spark, sf_dir), "sessions": down}
    return recalls.recall(lists, recalls.Plan(), texts=texts, rerank=rerank)


@query(
    "turns_exact",
    """WITH t AS (SELECT conv_id, turn, role, text, strlen(text) AS n FROM conversations WHERE coalesce(text, '') <> ''),
o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t QUALIFY count(*) OVER (PARTITION BY conv_id, turn) = 1),
k AS (SELECT conv_id, count(*) AS m, bool_or(role NOT IN ('user', 'assistant', 'system', 'tool') OR role IS NULL) AS odd FROM o GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 4 WHEN 1 THEN 'past' WHEN 2 THEN 'gap' WHEN 3 THEN 'content' ELSE 'whole' END AS kind, CAST(CASE conv_id % 4 WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS errors FROM k WHERE NOT odd AND m >= 2""",
)
def turns_exact(spark, sf_dir):
    """Conversations as sessions: of four, one is whole, one's last turn ends too late, one has lost its first turn, and one's first turn says something else."""
    own = table(spark, sf_dir, "conversations").filter("coalesce(text, '') <> ''").select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    twice = own.groupBy("session", "position").count().filter("count > 1").select("session", "position")
    own = own.join(twice, ["session", "position"], "left_anti")
    good = own.groupBy("session").agg(F.count("*").alias("m"), F.max("position").alias("last"), F.min("position").alias("first"), F.bool_and(F.coalesce(F.col("role").isin(turns.ROLES), F.lit(False))).alias("fine")).filter("fine AND m >= 2")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda t: t["content"]), "")
    sessions = own.join(good, "session", "left_semi").groupBy("session").agg(text.alias("text"))
    placed = turns.offsets(own.join(good, "session"))
    kind, at_last, at_first = F.col("session") % 4, F.col("position") == F.col("last"), F.col("position") == F.col("first")
    placed = placed.filter(~((kind == 2) & at_first)).withColumn("char_end", F.col("char_end") + F.when((kind == 1) & at_last, 1).otherwise(0)).withColumn("content", F.when((kind == 3) & at_first, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    errors = turns.turn_errors(sessions, placed).groupBy("session").agg(F.count("*").alias("errors"), F.first("error").alias("error"))
    said = F.when(F.col("error").isNull(), "whole").when(F.contains("error", F.lit("past")), "past").when(F.contains("error", F.lit("gap")), "gap").when(F.contains("error", F.lit("content")), "content").otherwise(F.col("error"))
    return sessions.join(errors, "session", "left").select(F.col("session").alias("conv_id"), said.alias("kind"), F.coalesce("errors", F.lit(0)).cast("long").alias("errors"))
