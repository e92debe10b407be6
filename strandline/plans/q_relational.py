"""Filters, joins, roll-ups and text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.scalars import tokens
from strandline.operators import matching, sessions

from .registry import query, table

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_MEMBER = "(SELECT DISTINCT conv_id, conv_id % 5 AS ws FROM conversations UNION SELECT DISTINCT conv_id, (conv_id + 1) % 5 FROM conversations WHERE conv_id % 7 = 0)"


def _members(spark, sf_dir):
    """Sessions by workspace; some belong to two."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    second = ids.filter("conv_id % 7 = 0").select("conv_id", F.expr("(conv_id + 1) % 5").alias("ws"))
    return ids.select("conv_id", F.expr("conv_id % 5").alias("ws")).union(second).distinct()


@query("src02_session_list", "SELECT DISTINCT conv_id FROM conversations")
def session_list(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct()


@query("src10_insert_ignore", f"SELECT conv_id, ws FROM {_MEMBER}")
def insert_ignore(spark, sf_dir):
    old = _members(spark, sf_dir).filter("ws < 3")
    fresh = _members(spark, sf_dir).join(old, ["conv_id", "ws"], "left_anti")
    return old.unionByName(fresh)


@query("src28_last_assistant", "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id")
def last_assistant(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query("flt01_scope", f"SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM {_MEMBER} WHERE ws = 2)")
def scope(spark, sf_dir):
    inside = _members(spark, sf_dir).filter("ws = 2").select("conv_id")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").join(inside, "conv_id", "left_semi").select("conv_id", "turn", "role")


@query("flt03_usable_vectors", "SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = (SELECT len(embedding) FROM embeddings WHERE vec_id = 0)")
def usable_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.filter("vec_id = 0").select(F.size("embedding").alias("n"))
    return vectors.filter("embedding IS NOT NULL").withColumn("n", F.size("embedding")).join(F.broadcast(n), "n", "left_semi").select("vec_id", "n")


@query("flt04_tag_overlap", f"SELECT doc_id FROM documents WHERE list_has_any({_TOK}, ['der', 'que'])")
def tag_overlap(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(tx.has_any(tokens(F.col("text")), ["der", "que"])).select("doc_id")


@query("flt09_all_terms", f"SELECT doc_id FROM documents WHERE list_has_all({_TOK}, ['the', 'and', 'that'])")
def all_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(tx.has_all(tokens(F.col("text")), ["the", "and", "that"])).select("doc_id")


@query("flt11_substring", "SELECT doc_id FROM documents WHERE text ILIKE '%m_nt%'")
def substring(spark, sf_dir):
    """As ILIKE: ``%`` and ``_`` in what is asked for are wildcards."""
    return table(spark, sf_dir, "documents").filter(F.ilike("text", F.lit("%m_nt%"))).select("doc_id")


@query("flt12_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def date_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1996-12-31'").select("o_orderkey")


@query("flt13_expiry", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderdate > TIMESTAMP '1997-06-01'")
def expiry(spark, sf_dir):
    """Rows that never expire (of lowest priority here) or not before the given day."""
    ends = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").filter(ends.isNull() | (ends > F.expr("TIMESTAMP_NTZ '1997-06-01'"))).select("o_orderkey")


@query("jn02_optional_text", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def optional_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("jn13_in_set_edges", "WITH k AS (SELECT l_partkey AS node FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R') SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT node FROM k) AND l_suppkey IN (SELECT node FROM k) GROUP BY ALL")
def in_set_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n"))
    nodes = table(spark, sf_dir, "lineitem").filter("l_quantity > 30 AND l_returnflag = 'R'").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("node"))
    return matching.inside(edges, nodes, "node").select("src", "dst", "n")


@query(
    "jn16_largest_overlap",
    "WITH c AS (SELECT DISTINCT o_custkey % 20 AS cluster, l_partkey AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT DISTINCT l_suppkey AS known, l_partkey AS m FROM lineitem), "
    "n AS (SELECT cluster, known, count(*) AS overlap FROM c JOIN k USING (m) GROUP BY ALL) SELECT cluster, known, overlap FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY overlap DESC, known) = 1",
)
def largest_overlap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    own = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.expr("o_custkey % 20").alias("cluster"), F.col("l_partkey").alias("m"))
    return matching.largest_overlap(own, lines.select(F.col("l_suppkey").alias("known"), F.col("l_partkey").alias("m")), "cluster", "known", "m")


@query("jn19_known_ids", "SELECT item_id, doc_id IS NULL AS missing FROM (SELECT item_id * 40 AS item_id FROM benchmark) LEFT JOIN documents ON doc_id = item_id")
def known_ids(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 40).alias("item_id"))
    return asked.join(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id") == F.col("item_id"), "left").select("item_id", F.isnull("doc_id").alias("missing"))


@query("jn22_enriched", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def enriched(spark, sf_dir):
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return table(spark, sf_dir, "orders").join(who, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("agg03_stats", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY source")
def stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.coalesce(F.sum(F.length("text")), F.lit(0).cast("long")).alias("chars"))


@query("agg05_totals", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM events) AS events")
def totals(spark, sf_dir):
    one = lambda t, name: table(spark, sf_dir, t).agg(F.count("*").alias(name))
    return one("documents", "documents").crossJoin(one("conversations", "turns")).crossJoin(one("events", "events"))


@query("agg06_distribution", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def distribution(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("agg07_top_tags", "SELECT tag, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, unnest([l_returnflag, l_linestatus]) AS tag FROM lineitem) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.explode(F.array("l_returnflag", "l_linestatus")).alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("agg08_next_version", "WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders) SELECT c_custkey, coalesce(max(version) FILTER (WHERE age <= 3), 0) + 1 AS next FROM customer LEFT JOIN v ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(spark, sf_dir):
    """One past the largest version that is left after old ones were pruned."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    back = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    kept = table(spark, sf_dir, "orders").withColumns({"version": F.row_number().over(order), "age": F.row_number().over(back)}).filter("age <= 3")
    last = kept.groupBy("o_custkey").agg(F.max("version").cast("long").alias("last"))
    return table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", (F.coalesce("last", F.lit(0)) + 1).alias("next"))


@query("agg20_cluster_words", f"SELECT lang, w, count(*) AS freq, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS place FROM (SELECT lang, unnest({_TOK}) AS w FROM documents) GROUP BY lang, w QUALIFY place <= 5")
def cluster_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("w"))
    return matching.most_frequent(words, "lang", "w", 5)


@query("agg24_rates", "SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang))")
def rates(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("rate"))


@query(
    "agg25_means_of_means",
    "SELECT event_type, count(*) AS n, round(avg(m), 6) AS mean, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(m) / sqrt(count(*)) ELSE 0 END, 6) AS half_width FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type",
)
def means_of_means(spark, sf_dir):
    out = matching.means_of_means(table(spark, sf_dir, "events"), "event_type", "user_id", "value")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


@query("agg30_chunk_maximum", "SELECT doc_id, CAST(coalesce(list_max(list_transform(generate_series(1, length(text), 1500), lambda i: len(regexp_extract_all(lower(text[i:i + 1499]), '[a-z0-9]+')))), 0) AS BIGINT) AS most FROM documents")
def chunk_maximum(spark, sf_dir):
    """The best chunk of each text, scored by its words; texts without a chunk score 0."""
    scores = F.transform(tx.chunks(F.col("text")), lambda c: F.size(tokens(c)))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_max(scores), F.lit(0)).cast("long").alias("most"))


@query("agg32_idf", f"SELECT w, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM (SELECT unnest(list_distinct({_TOK})) AS w FROM documents) GROUP BY w")
def idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("w", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query("win03_history_page", "SELECT o_custkey, o_orderkey, version FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS version FROM orders) WHERE version BETWEEN 4 AND 6")
def history_page(spark, sf_dir):
    """The second page, of three, of each customer's history, newest first."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(order)).filter("version BETWEEN 4 AND 6").select("o_custkey", "o_orderkey", "version")


@query("win09_open_session", "SELECT user_id, event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def open_session(spark, sf_dir):
    """Each user's latest event, where it is fresh."""
    events = table(spark, sf_dir, "events")
    fresh = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))).filter("ts > now - INTERVAL 1 DAY")
    return sessions.latest(fresh, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("fn11_sentences", r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda s: s <> '')) AS INT) AS n FROM documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n"))


@query("fn12_approximate_tokens", "SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS n, left(text, 400) AS head FROM documents")
def approximate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.approximate_tokens(F.col("text")).alias("n"), F.left("text", F.lit(400)).alias("head"))


@query("fn14_chunks", "SELECT doc_id, i AS nth, text[(i - 1) * 1500 + 1:i * 1500] AS chunk FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 1500) AS BIGINT))) AS i FROM documents)")
def chunked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("nth", "chunk")).select("doc_id", (F.col("nth") + 1).cast("long").alias("nth"), "chunk")


@query("fn15_concept_key", "SELECT doc_id, lower(regexp_replace(replace(left(text, 50), ' ', '_'), '[^A-Za-z0-9_-]', '', 'g')) AS key FROM documents")
def concept_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.concept_key(F.col("text")).alias("key"))


@query("fn44_cache_key", "SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.cache_key(F.col("doc_id"), F.col("lang"), F.col("source")).alias("key"))


@query("fn37_reciprocal_rank", "SELECT user_id, min(r) AS first, round(coalesce(1.0 / min(r), 0), 6) AS rr, coalesce(min(r) <= 5, false) AS hit5 FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) END AS r FROM events) GROUP BY user_id")
def reciprocal_rank(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(order).cast("long").alias("r"))
    first = ranked.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("r"))).alias("first"))
    return first.select("user_id", "first", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.coalesce(F.col("first") <= 5, F.lit(False)).alias("hit5"))
