"""Sessions, versions, filters, roll-ups and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import metrics, sessions
from strandline.streaming.coactivation import activity

from .registry import query, table

GAP = "INTERVAL 4 HOURS"
_SEG = f"SELECT event_id, user_id, ts, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {GAP}, false) AS new FROM events)"


def _segments(spark, sf_dir):
    return sessions.segments(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "4 HOURS")


@query("win05_gap_segments", f"SELECT event_id, user_id, segment FROM ({_SEG})")
def gap_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("event_id", "user_id", "segment")


@query("win06_segment_plan", f"SELECT user_id, segment, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, segment = max(segment) OVER (PARTITION BY user_id) AS keeps_id FROM ({_SEG}) GROUP BY user_id, segment")
def segment_plan(spark, sf_dir):
    rows = _segments(spark, sf_dir).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("user_id", "segment", "n", us("a").alias("first_us"), us("b").alias("last_us"), (F.col("segment") == F.max("segment").over(Window.partitionBy("user_id"))).alias("keeps_id"))


@query("agg01_session_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations WHERE text <> '' GROUP BY conv_id")
def session_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text <> ''").select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("body"))


@query("agg02_session_rollup", "SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_rollup(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("agg04_filtered_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.countDistinct("user_id").alias("users"))


@query("win01_latest_version", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version(spark, sf_dir):
    return sessions.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("win02_keep_newest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3")
def prunable(spark, sf_dir):
    """Versions past the newest three, which may be deleted."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("n", n).filter("n > 3").select("o_custkey", "o_orderkey")


@query("src09_upsert_flags", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1995-01-01' THEN o_orderdate >= TIMESTAMP '1997-01-01' END AS inserted FROM orders")
def upsert_flags(spark, sf_dir):
    """Orders up to 1996 are known; those from 1995 on come in."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sessions.upsert(orders.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01'"), orders.filter("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'"), "o_orderkey").select("o_orderkey", "inserted")


@query("win07_clean_prefix", "SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b = 0")
def clean_prefix(spark, sf_dir):
    return sessions.clean_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") > 400).select("conv_id", "turn")


@query("win08_neighbours", "SELECT conv_id, turn FROM (SELECT *, length(text) > 400 AS k, lag(length(text) > 400) OVER w AS p, lead(length(text) > 400) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE k OR coalesce(p, false) OR coalesce(n, false)")
def neighbours(spark, sf_dir):
    w, kept = Window.partitionBy("conv_id").orderBy("turn"), F.length("text") > 400
    near = kept | F.coalesce(F.lag(kept).over(w), F.lit(False)) | F.coalesce(F.lead(kept).over(w), F.lit(False))
    return table(spark, sf_dir, "conversations").withColumn("near", near).filter("near").select("conv_id", "turn")


@query("win11_turn_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def turn_offsets(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long").alias("start"))


@query("win12_auc", "WITH s AS (SELECT n_chars AS s, toxic FROM documents JOIN labels USING (doc_id)), p AS (SELECT s, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS q FROM s GROUP BY s), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 9) AS auc FROM b")
def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.auc(rows, "n_chars", "toxic").withColumn("auc", F.round("auc", 9))


@query("fn35_entropy", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT round(-sum(n / t * log2(n / t)), 9) AS entropy FROM c, (SELECT sum(n) AS t FROM c)")
def entropy(spark, sf_dir):
    return metrics.entropy(table(spark, sf_dir, "documents"), "source").select(F.round("entropy", 9).alias("entropy"))


@query("agg26_primary_bucket", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def primary_bucket(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sessions.latest(counts, ["user_id"], F.desc("n"), F.asc("event_type")).select("user_id", "event_type")


@query("flt05_token_containment", "SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ['the', 'and', 'of'])")
def token_containment(spark, sf_dir):
    need = F.array(*map(F.lit, ("the", "and", "of")))
    return table(spark, sf_dir, "documents").filter(F.size(F.array_except(need, scalars.tokens(F.col("text")))) == 0).select("doc_id")


@query("flt15_soft_delete", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 AND source = 'src0' THEN '[forgotten]' ELSE text END AS text FROM documents")
def soft_delete(spark, sf_dir):
    gone = (F.col("doc_id") % 10 == 0) & (F.col("source") == "src0")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(gone, "[forgotten]").otherwise(F.col("text")).alias("text"))


@query("flt22_excluded_authors", "SELECT doc_id FROM documents WHERE lower(source) NOT IN ('src0', 'src1')")
def excluded(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~F.lower("source").isin("src0", "src1")).select("doc_id")


@query("flt23_hold_out", "SELECT doc_id, list_reduce(list_prepend(0, list_transform(string_split(sha256(CAST(doc_id AS VARCHAR)), ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda m, d: (m * 16 + d) % 100) < 20 AS held FROM documents")
def hold_out(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.held_out(F.col("doc_id").cast("string")).alias("held"))


@query("jn10_anti_join", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jn01_scoped_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_0'")
def scoped(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter("n_name = 'NATION_0'")
    members = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, sf_dir, "orders").join(members, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("fn22_scalars", "SELECT event_id, round(CASE WHEN value / 10 > 20 THEN value / 10 ELSE ln(1 + exp(value / 10)) END, 6) AS softplus, round(0.95 * 0.24 / greatest(0.24 + 0.7 * 0.2, 1e-9) + 0.025, 6) AS bayes FROM events")
def scalar_functions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.softplus(F.col("value") / 10), 6).alias("softplus"), F.round(scalars.bayes(F.lit(0.3), F.lit(0.8)), 6).alias("bayes"))


@query("set04_distinct_union", "SELECT key, min(pos) AS pos FROM (SELECT o_custkey AS key, o_orderkey AS pos FROM orders UNION ALL SELECT c_custkey, 100000000 + c_custkey FROM customer) GROUP BY key")
def distinct_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.lit(100000000) + F.col("c_custkey")).alias("pos"))
    return a.unionByName(b).groupBy("key").agg(F.min("pos").alias("pos"))


@query("stream_activity", "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly(spark, sf_dir):
    rows = activity(table(spark, sf_dir, "events"))
    return rows.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))
