"""Queries of contradictions: a stream that flags, verdicts between its batches, and what verbs do to confidence and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import contradictions
from strandline.operators.lineage import scratch
from strandline.streaming.contradictions import Queue, flag_stream

from .registry import query, table

_FLAGS = """WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id % 7 <> 3 AS active, source AS content FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE label IS NOT NULL),
n AS (SELECT a.vec_id AS a, b.vec_id AS b, a.content AS one, b.content AS other, list_cosine_similarity(a.v, b.v) AS s FROM m a JOIN m b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.active WHERE a.vec_id % 50 = 0),
f AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM n) WHERE place <= 50 AND s >= 0.1 AND one IS DISTINCT FROM other)"""


@query(
    "st15_stream_contradictions",
    f"""{_FLAGS}, j AS (SELECT *, a % 100 = 0 AND (a + b) % 3 < 2 AS judged FROM f)
SELECT a, b, 0 AS nth, round(s, 6) AS similarity, CASE WHEN judged THEN CASE (a + b) % 3 WHEN 0 THEN 'confirmed' ELSE 'dismissed' END ELSE 'pending' END AS status FROM j
UNION ALL SELECT a, b, 1, round(s, 6), 'pending' FROM j WHERE judged""",
)
def stream_contradictions(spark, sf_dir):
    """New memories (every fiftieth vector) flagged against all of their label: half of them stream in, verdicts come, then the stream starts again and gets all of them."""
    content = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("content"))
    state = F.when(F.col("vec_id") % 7 != 3, "active").otherwise("archived")
    rows = table(spark, sf_dir, "embeddings").join(content, "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("label").alias("space"), state.alias("state"), "content", F.col("embedding").alias("vec"))
    new = rows.filter("id % 50 = 0").select("id")
    arrivals, where, checkpoint = (scratch(spark, n) for n in ("arrivals", "queue", "checkpoint"))
    queue = Queue(spark, where, new.schema["id"].dataType.simpleString(), 8)
    for part in (new.filter("id % 100 = 0"), new):  # the verdicts come between
        part.write.mode("append").parquet(arrivals)
        flag_stream(spark.readStream.schema(new.schema).parquet(arrivals), lambda: rows, where, checkpoint, least=0.1, buckets=8).awaitTermination()
        if part is new:
            break
        verdict = F.when((F.col("a") + F.col("b")) % 3 == 0, "confirmed").when((F.col("a") + F.col("b")) % 3 == 1, "dismissed")
        queue.resolve(queue.next_batch(), queue.read().select("a", "b", verdict.alias("verdict")).filter("verdict IS NOT NULL"))
    return queue.read().select("a", "b", "nth", F.round("similarity", 6).alias("similarity"), "status")


_ALL = "WITH RECURSIVE p AS (SELECT l_suppkey AS a, l_partkey AS b, l_returnflag AS flag FROM lineitem WHERE l_linenumber = 1), "


def _memories(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") + 1) / 60).alias("confidence"), F.lit("active").alias("state"))


def _said(spark, sf_dir, flag):
    return table(spark, sf_dir, "lineitem").filter((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == flag)).select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit("hebbian").alias("kind"), (F.col("p_size") / 60).alias("weight"))


@query(
    "udf03_verbs_memories",
    _ALL
    + """n AS (SELECT id, count(*) FILTER (WHERE e = 0.1) AS against, count(*) FILTER (WHERE e = 0.65) AS fo FROM (SELECT a AS id, 0.1 AS e FROM p WHERE flag = 'R' UNION ALL SELECT b, 0.65 FROM p WHERE flag = 'N' AND a <> b AND a IN (SELECT p_partkey FROM part) AND b IN (SELECT p_partkey FROM part)) GROUP BY id),
s AS (SELECT p_partkey AS id, (p_size + 1) / 60.0::DOUBLE AS c, coalesce(against, 0) AS against, coalesce(fo, 0) AS fo FROM part LEFT JOIN n ON id = p_partkey UNION ALL
SELECT id, 0.95 * c * e / greatest(c * e + (1 - c) * (1 - e), 1e-9) + 0.025, greatest(against - 1, 0), CASE WHEN against > 0 THEN fo ELSE fo - 1 END FROM (SELECT *, CASE WHEN against > 0 THEN 0.1::DOUBLE ELSE 0.65::DOUBLE END AS e FROM s WHERE against + fo > 0))
SELECT id, round(c, 6) AS confidence, CASE WHEN id IN (SELECT b FROM p WHERE flag = 'A' AND a <> b AND a IN (SELECT p_partkey FROM part)) THEN 'archived' ELSE 'active' END AS state FROM s WHERE against + fo = 0""",
)
def verbs_memories(spark, sf_dir):
    """Confidence and state after all confirmed contradictions, then all supports, then what was superseded; what comes more than once counts each time."""
    rows, edges = contradictions.confirm(_memories(spark, sf_dir), _edges(spark, sf_dir), _said(spark, sf_dir, "R"))
    rows, edges, _ = contradictions.support(rows, edges, _said(spark, sf_dir, "N"))
    rows, _, _ = contradictions.supersede(rows, edges, _said(spark, sf_dir, "A"))
    return rows.select("id", F.round("confidence", 6).alias("confidence"), "state")


@query(
    "udf03_verbs_edges",
    _ALL
    + """k AS (SELECT DISTINCT a, b, CASE flag WHEN 'N' THEN 'supports' ELSE 'supersedes' END AS kind FROM p WHERE flag <> 'R' AND a <> b AND a IN (SELECT p_partkey FROM part) AND b IN (SELECT p_partkey FROM part)),
t AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS n FROM p WHERE flag = 'R' GROUP BY ALL)
SELECT p_partkey AS src, p_partkey + 1 AS dst, 'hebbian' AS kind, round(p_size / 60.0 * pow(0.1, coalesce(n, 0)), 6) AS weight FROM part LEFT JOIN t ON src = p_partkey AND dst = p_partkey + 1
UNION ALL SELECT DISTINCT a, b, 'contradicts', 1.0 FROM p WHERE flag = 'R' UNION ALL SELECT a, b, kind, 1.0 FROM k""",
)
def verbs_edges(spark, sf_dir):
    """Edges after the same."""
    rows, edges = contradictions.confirm(_memories(spark, sf_dir), _edges(spark, sf_dir), _said(spark, sf_dir, "R"))
    rows, edges, _ = contradictions.support(rows, edges, _said(spark, sf_dir, "N"))
    _, edges, _ = contradictions.supersede(rows, edges, _said(spark, sf_dir, "A"))
    return edges.withColumn("weight", F.round("weight", 6))
