"""Consolidation, compressors, rules over texts, streams' batch forms and SQL functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import rules, scalars, sql
from strandline.functions.text import chunks
from strandline.operators import consolidate, graph, memory, ranking, search

from .q_recall import _BM25, _EDGES, _VEC, _keyword, _pairs, _vector
from .registry import query, table

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


# --- rules over texts and values ----------------------------------------------------------------------------


@query("fn04_vector_text", "SELECT vec_id, len(embedding) AS dims, true AS same FROM embeddings")
def vector_text(spark, sf_dir):
    """A vector written as text and read back."""
    back = F.from_json(F.to_json("embedding"), "array<float>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), (back == F.col("embedding")).alias("same"))


@query("fn13_byte_truncation", "WITH c AS (SELECT doc_id, text, unnest(string_split(left(text, 61), '')) AS c, generate_subscripts(string_split(left(text, 61), ''), 1) AS i FROM documents WHERE text <> ''), r AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM c) SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE b <= 61), '') AS head FROM r GROUP BY doc_id")
def byte_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", rules.truncated(F.col("text"), 61).alias("head"))


_PARTS = "string_split(trim(regexp_replace(coalesce(regexp_replace(url, '^https?:/', ''), ''), '^/*(\\./)?', '')), '/')"


@query("fn18_module_bucket", f"WITH p AS (SELECT page_id, {_PARTS} AS p FROM pages), q AS (SELECT *, len(p) AS n, contains(p[-1], '.') OR lower(p[-1]) IN ('makefile', 'dockerfile', 'rakefile') AS f FROM p) SELECT page_id, CASE WHEN n = 1 THEN '.' WHEN n > 3 OR n = 3 AND NOT f THEN array_to_string(p[1:3], '/') ELSE array_to_string(p[1:n - 1], '/') END AS module FROM q")
def module_bucket(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.module(F.regexp_replace("url", "^https?:/", "")).alias("module"))


_CAP = "regexp_matches(s, '^\\p{Lu}') AND (length(s) = 1 OR regexp_matches(s, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]'))"
_NAMES = f"""
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') AS w FROM documents)),
u AS (SELECT *, {_CAP} AS cap FROM (SELECT *, ltrim(rtrim(w, '.,;:!?)'), '("''') AS s FROM t)),
g AS (SELECT *, count(*) FILTER (WHERE NOT cap) OVER (PARTITION BY doc_id ORDER BY i) AS g, last_value(CASE WHEN NOT cap THEN w END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM u),
r AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS e, count(*) AS n, any_value(before) AS before FROM g WHERE cap GROUP BY doc_id, g)"""


@query("fn16_entities", f"WITH {_NAMES}, x AS (SELECT doc_id, e FROM r WHERE n > 1 OR NOT coalesce(regexp_matches(before, '[.!?]$'), true)" + "".join(f" UNION ALL SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{p}', {g})) FROM documents" for p, g in rules.MARKED) + ") SELECT doc_id, count(DISTINCT lower(trim(e))) AS n, md5(string_agg(DISTINCT lower(trim(e)), '|' ORDER BY lower(trim(e)))) AS digest FROM x WHERE trim(e) <> '' GROUP BY doc_id")
def entities(spark, sf_dir):
    """Names, identifiers, quoted phrases and mentions of each document that has any."""
    found = table(spark, sf_dir, "documents").select("doc_id", rules.entities(F.col("text")).alias("e")).filter(F.size("e") > 0)
    return found.select("doc_id", F.size("e").alias("n"), F.md5(F.array_join("e", "|")).alias("digest"))


@query("fn28_linear_score", "SELECT p_partkey, round(p_size / 50.0, 6) AS hebbian_only, round(p_size / 50.0 + 0.5 * p_retailprice / 2000, 6) AS weighted FROM part")
def linear_score(spark, sf_dir):
    parts = {"hebbian": F.col("p_size") / 50, "bayesian": F.col("p_retailprice") / 2000}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.linear(parts), 6).alias("hebbian_only"), F.round(scalars.linear(parts, {"hebbian": 1.0, "bayesian": 0.5}), 6).alias("weighted"))


@query("fn29_mode_weights", "SELECT o_orderkey, round(o_totalprice / 100000 * v + o_custkey / 100.0 * t, 8) AS score FROM orders JOIN (VALUES ('F', 1.0, 0.0), ('O', 0.0, 1.0), ('P', 0.7, 0.3)) m(s, v, t) ON s = o_orderstatus")
def mode_weights(spark, sf_dir):
    """A search's mode gives the weights of vector and text."""
    state = {"F": "semantic", "O": "keyword", "P": "hybrid"}
    score = F.coalesce(*(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice") / 100000 * scalars.MODES[m][0] + F.col("o_custkey") / 100 * scalars.MODES[m][1]) for s, m in state.items()))
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin(*state)).select("o_orderkey", F.round(score, 8).alias("score"))


@query("fn30_next_run", "SELECT event_id, CASE WHEN d > 0 THEN d ELSE d + 86400 END AS seconds FROM (SELECT event_id, 3 * 3600 - (epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('day', ts))::BIGINT) AS d FROM events)")
def next_run(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rules.until_hour(F.col("ts"), 3).alias("seconds"))


@query("fn39_facts", f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(coalesce(text, '')) WHEN len({_TOK}) = 0 THEN '' ELSE '- ' || array_to_string({_TOK}, chr(10) || '- ') END AS facts FROM conversations")
def facts(spark, sf_dir):
    """Every third turn is prose, the others are JSON answers of their words."""
    words = F.to_json(F.struct(scalars.tokens(F.col("text")).alias("facts")))
    raw = F.when(F.col("turn") % 3 == 0, F.coalesce("text", F.lit(""))).otherwise(words)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.facts(raw).alias("facts"))


@query("fn41_wrong_era", "SELECT o_orderkey, era, arg_min(other, sha256(o_orderkey || '|' || other)) AS wrong FROM (SELECT o_orderkey, year(o_orderdate)::INT AS era FROM orders) JOIN (SELECT DISTINCT year(o_orderdate)::INT AS other FROM orders) ON other <> era GROUP BY ALL")
def wrong_era(spark, sf_dir):
    """Another era for each case, chosen by a hash of both instead of a seeded generator; there are few eras."""
    orders = table(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL").select("o_orderkey", F.year("o_orderdate").alias("era"))
    others = orders.agg(F.collect_set("era").alias("eras"))  # one row, of the years there are
    digest = lambda e: F.struct(F.sha2(F.concat_ws("|", "o_orderkey", e), 256).alias("h"), e.alias("era"))
    rest = F.filter("eras", lambda e: e != F.col("era"))
    return orders.crossJoin(F.broadcast(others)).filter(F.size(rest) > 0).select("o_orderkey", "era", F.array_min(F.transform(rest, digest))["era"].alias("wrong"))


_MEAN = "list_avg(CAST(embedding[{}] AS DOUBLE[]))"


@query("fn42_direction", f"SELECT vec_id, round(({_MEAN.format('1:8')} - {_MEAN.format('9:16')}) - ({_MEAN.format('17:24')} - {_MEAN.format('25:32')}), 6) AS d FROM embeddings")
def direction(spark, sf_dir):
    """Which of two texts predicts the other, from token log-probabilities (here: runs of a vector)."""
    part = lambda a: F.slice("embedding", a, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.direction(part(1), part(9), part(17), part(25)), 6).alias("d"))


# --- recall: scopes, sessions, reranking ---------------------------------------------------------------------


@query("top04_keyword_in_scope", f"SELECT query, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, key) AS rank FROM ({_BM25}) JOIN documents a ON a.doc_id = query JOIN documents b ON b.doc_id = key AND b.lang = a.lang QUALIFY rank <= 10")
def keyword_in_scope(spark, sf_dir):
    """The ten best documents of the query's own language."""
    return _keyword(spark, sf_dir, 10, 6, scope="lang").select("query", "key", "score", "rank")


@query("top05_session_topk", "WITH d AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM d GROUP BY label), q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0) SELECT query, label AS key, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(v, q) DESC, label) AS rank FROM q, c QUALIFY rank <= 5")
def session_topk(spark, sf_dir):
    """The five sessions (labels) whose pooled vector is nearest to each query."""
    vectors = table(spark, sf_dir, "embeddings")
    dims = memory.pooled(vectors, "label", F.lit(1.0))
    pooled = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    return search.nearest(pooled, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), 5, key="label").select("query", "key", "rank")


@query("top07_boost_topk", f"WITH e AS ({_EDGES}), c AS (SELECT p_partkey AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos, p_brand FROM part), b AS (SELECT src, sum(weight) AS boost FROM e WHERE dst IN (SELECT key FROM c) GROUP BY src) SELECT p_brand, key, pos, round(coalesce(boost, 0), 6) AS boost FROM c LEFT JOIN b ON src = key QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(coalesce(boost, 0), 6) DESC, pos) <= 20")
def boost_topk(spark, sf_dir):
    """The twenty candidates of each list with the highest boost; equal boosts keep the list's order."""
    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand", pos.alias("pos"))
    boosts = graph.boosts(graph.fold(_pairs(spark, sf_dir)), candidates).withColumn("boost", F.round("boost", 6))
    best = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("boost"), "pos"))
    return candidates.join(boosts, "key").withColumn("best", best).filter("best <= 20").select("p_brand", "key", "pos", "boost")


_CHUNKS = "SELECT doc_id AS key, unnest(CASE WHEN length(text) > 0 THEN list_transform(range(0, length(text), 1500), lambda i: substr(text, i + 1, 1500)) ELSE [] END) AS text FROM documents"


@query("ml03_rerank", f"WITH v AS ({_VEC}), w AS (SELECT doc_id AS query, list_distinct({_TOK}[1:20]) AS q FROM documents WHERE doc_id % 50 = 0), c AS (SELECT key, {_TOK} AS t FROM ({_CHUNKS})), s AS (SELECT query, key, rank, max(len(list_intersect(q, t)) / greatest(len(q), 1)) AS score FROM v JOIN w USING (query) JOIN c USING (key) GROUP BY ALL) SELECT query, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, rank) AS place FROM s QUALIFY place <= 10")
def rerank(spark, sf_dir):
    """A pool of fifty by vector, scored anew by its best chunk (share of the query's words), cut to ten; hits without text are left out (top09, top19)."""
    docs, pool = table(spark, sf_dir, "documents"), _vector(spark, sf_dir).select("query", "key", "rank")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.array_distinct(F.slice(scalars.tokens(F.col("text")), 1, 20)).alias("q"))
    parts = docs.select(F.col("doc_id").alias("key"), F.explode(F.transform(chunks(F.col("text")), scalars.tokens)).alias("t"))
    share = F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1))
    return ranking.reranked(pool.join(asked, "query").join(parts, "key").select("query", "key", "rank", share.alias("score")), 10)


@query("win04_rank_in_tier", "SELECT label, vec_id AS key, round(embedding[1]::DOUBLE, 4) AS score, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 4) DESC, vec_id) AS rank FROM embeddings")
def rank_in_tier(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("key"), F.round(F.col("embedding")[0].cast("double"), 4).alias("score")), "label")


# --- sources --------------------------------------------------------------------------------------------------


@query("src21_bundle", "SELECT o_orderkey, count(*) AS n, string_agg(line, chr(10) ORDER BY d, line) AS body FROM (SELECT o_orderkey, o_orderdate AS d, 'issue ' || o_orderkey || ' by ' || o_custkey AS line FROM orders UNION ALL SELECT o_orderkey, l_shipdate, 'commit ' || l_linenumber || ': ' || l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE lower(l_returnflag) <> 'r') WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE lower(l_returnflag) <> 'r') GROUP BY o_orderkey")
def bundle(spark, sf_dir):
    """A record an issue with its commits in order of time; commits of an excluded author go, and issues that then have none."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter(F.lower("l_returnflag") != "r")
    issue = orders.select("o_orderkey", F.col("o_orderdate").alias("at"), F.concat(F.lit("issue "), "o_orderkey", F.lit(" by "), "o_custkey").alias("line"))
    commit = items.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"), F.concat(F.lit("commit "), "l_linenumber", F.lit(": "), "l_returnflag").alias("line"))
    has = commit.select("o_orderkey").distinct()
    events = issue.join(has, "o_orderkey", "left_semi").unionByName(commit.join(orders, "o_orderkey", "left_semi"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda e: e["line"])
    return events.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.array_join(body, "\n").alias("body"))


@query("src25_case_errors", "SELECT conv_id, count(*) AS turns, concat_ws(',', CASE WHEN bool_or(coalesce(text, '') = '') THEN 'empty' END, CASE WHEN bool_or(role IS NULL OR role NOT IN ('user', 'assistant')) THEN 'role' END, CASE WHEN count(DISTINCT turn) < count(*) THEN 'turn' END) AS errors FROM conversations GROUP BY conv_id")
def case_errors(spark, sf_dir):
    """What is wrong with each case; a loader takes those without errors (flt24)."""
    has = lambda c, name: F.when(c, name)
    errors = F.concat_ws(",", has(F.bool_or(F.coalesce("text", F.lit("")) == ""), "empty"), has(F.bool_or(F.isnull("role") | ~F.col("role").isin("user", "assistant")), "role"), has(F.count_distinct("turn") < F.count("*"), "turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), errors.alias("errors"))


@query("src30_vector_backstop", "SELECT doc_id, CASE WHEN vec_id IS NOT NULL THEN 'own' WHEN coalesce(text, '') = '' THEN 'none' ELSE 'made' END AS origin, CASE WHEN vec_id IS NOT NULL THEN len(embedding) WHEN coalesce(text, '') = '' THEN NULL ELSE 2 END AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id AND label < 5")
def vector_backstop(spark, sf_dir):
    """Rows with text but no vector get one from the embedder (here: two lengths)."""
    have = table(spark, sf_dir, "embeddings").filter("label < 5").select(F.col("vec_id").alias("doc_id"), "embedding")
    made = F.array(F.length("text").cast("float"), F.octet_length("text").cast("float"))
    rows = table(spark, sf_dir, "documents").join(have, "doc_id", "left")
    origin = F.when(F.isnotnull("embedding"), "own").when(F.coalesce("text", F.lit("")) == "", "none").otherwise("made")
    vector = F.when(origin == "made", made).otherwise(F.col("embedding"))
    return rows.select("doc_id", origin.alias("origin"), F.when(vector.isNotNull(), F.size(vector)).alias("dims"))


# --- consolidation ----------------------------------------------------------------------------------------------


@query("ml13_apply_clusters")
def apply_clusters(spark, sf_dir):
    """Memories of a nation: the customers of a segment; clusters: those of a balance class. Sequential in a space, so without SQL."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("space"), "c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 2000).alias("class"))
    known = rows.groupBy("space", F.col("c_mktsegment").alias("id")).agg(F.array_sort(F.collect_set("c_custkey")).alias("members"), F.lit(0.5).alias("confidence"))
    return consolidate.apply_clusters(known, rows.groupBy("space", "class").agg(F.collect_set("c_custkey").alias("members")).drop("class"))


@query("ml14_enriched", "SELECT c_custkey, CASE WHEN n > 0 THEN coalesce(state, c_mktsegment) ELSE c_mktsegment END AS label, CASE WHEN n > 0 THEN total ELSE c_acctbal END AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS state, round(max(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def enriched(spark, sf_dir):
    """A label changes only where one was found, the rest is overwritten."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "pending")).alias("label"), F.round(F.max("o_totalprice"), 2).alias("total"))
    known = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("total"))
    return consolidate.enriched(known, found, "c_custkey", ["label"], ["total"])


@query("ml15_digests", "WITH k AS (SELECT o_custkey AS space, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS level, 'active' AS state FROM orders), d AS (SELECT c_custkey AS space, -c_custkey - 1 AS id FROM customer WHERE c_acctbal > 0) SELECT space, id, level, CASE WHEN level = 2 AND space IN (SELECT space FROM d) THEN 'archived' ELSE state END AS state FROM k UNION ALL SELECT space, id, 2, 'active' FROM d")
def digests(spark, sf_dir):
    """A new digest archives those a space had."""
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("space"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("level"), F.lit("active").alias("state"))
    new = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("space"), (-F.col("c_custkey") - 1).alias("id"))
    return consolidate.with_digests(known, new, "space")


@query("ml20_jaccard_graph", f"WITH t AS (SELECT conv_id, turn, list_distinct({_TOK}) AS w FROM conversations) SELECT a.conv_id, a.turn AS src, b.turn AS dst, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS weight FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.1")
def jaccard_graph(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.tokens(F.col("text")).alias("w"))
    return consolidate.jaccard_graph(turns, "conv_id", "turn", "w").withColumn("weight", F.round("weight", 6))


@query("ml22_truncate_tokens", "SELECT conv_id, turn, left(text, 400 - before) AS text FROM (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations) WHERE before < 400")
def truncate_tokens(spark, sf_dir):
    return consolidate.first_tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 100)


@query("ml22_with_neighbours", "WITH t AS (SELECT conv_id, turn, length(text) // 4 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) // 4 DESC, turn) AS best FROM conversations WHERE text IS NOT NULL), k AS (SELECT * FROM t WHERE best = 1), n AS (SELECT t.conv_id, t.turn, t.cost, sum(t.cost) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS run, 400 - k.cost AS room FROM t JOIN k ON k.conv_id = t.conv_id AND abs(k.turn - t.turn) = 1) SELECT conv_id, turn, cost FROM k UNION ALL SELECT conv_id, turn, cost FROM n WHERE run <= room")
def kept_with_neighbours(spark, sf_dir):
    """The longest turn of each conversation, and its neighbours as far as a budget reaches."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("cost"))
    best = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("cost"), "turn"))
    return consolidate.with_neighbours(turns.withColumn("best", best).filter("best = 1").drop("best"), turns, "conv_id", "turn", 400)


@query("ml26_density_surprise", f"SELECT query, round(1 - avg(score), 6) AS surprise FROM (SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM ({_VEC}) WHERE key <> query) WHERE n <= 10 GROUP BY query")
def density_surprise(spark, sf_dir):
    """How far each query's ten nearest others are on average."""
    others = _vector(spark, sf_dir, 11).filter("key <> query")
    near = others.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter("n <= 10")
    return near.groupBy("query").agg(F.round(1 - F.avg("score"), 6).alias("surprise"))


@query("ml27_graph_features", f"WITH e AS ({_EDGES}), w AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT node, count(*) AS degree, round(sum(weight), 6) AS strength, count(*) FILTER (WHERE other IN (SELECT p_partkey FROM part WHERE p_size > 40)) AS seeds FROM w GROUP BY node")
def graph_features(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("other"), F.lit(True).alias("seed"))
    ways = graph.both_ways(graph.fold(_pairs(spark, sf_dir))).join(seeds, "other", "left")
    return ways.groupBy("node").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 6).alias("strength"), F.count_if("seed").alias("seeds"))


# --- state ------------------------------------------------------------------------------------------------------


@query("st04_backfill_batches", "SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch, doc_id FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def backfill_batches(spark, sf_dir):
    """Rows that wait for a vector, oldest first, 64 at a time from each source."""
    done = table(spark, sf_dir, "embeddings").filter("label < 5").select(F.col("vec_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").filter("text <> ''").join(done, "doc_id", "left_anti").select("source", F.floor((place - 1) / 64).alias("batch"), "doc_id")


@query("st09_fold_into_known", f"SELECT src, dst, n + coalesce(p_size, 0) AS n, round(1 - exp(-(n + coalesce(p_size, 0)) / 5.0), 9) AS weight FROM ({_EDGES}) LEFT JOIN part ON src = p_partkey AND dst = p_partkey + 1 UNION ALL SELECT p_partkey, p_partkey + 1, p_size, round(1 - exp(-p_size / 5.0), 9) FROM part WHERE NOT EXISTS (FROM ({_EDGES}) WHERE src = p_partkey AND dst = p_partkey + 1)")
def fold_into_known(spark, sf_dir):
    """A queue's pairs, added to the counts there were."""
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.col("p_size").cast("long").alias("n"))
    return graph.fold(_pairs(spark, sf_dir), known).withColumn("weight", F.round("weight", 9))


@query("st17_session_windows", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    """Sessions that end after a gap of more than four hours; the same plan runs on a stream with a watermark."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "4 hours"))
    return rows.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session_window")


@query("agg23_lift_by_era", "WITH h AS (SELECT o_orderpriority AS variant, year(o_orderdate)::INT AS era, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM orders GROUP BY ALL) SELECT h.variant, h.era, h.n, round(h.rate, 6) AS rate, round(h.rate - b.rate, 6) AS lift, least(h.n, b.n) AS least_n FROM h JOIN h b ON b.era = h.era AND b.variant = '1-URGENT'")
def lift_by_era(spark, sf_dir):
    """Rate of hits of each variant in each era, how much it beats the first variant there, and the smaller of the two denominators."""
    rate = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("variant"), F.year("o_orderdate").alias("era")).agg(F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("rate"), F.count("*").alias("n"))
    base = rate.filter("variant = '1-URGENT'").select("era", F.col("rate").alias("base"), F.col("n").alias("base_n"))
    return rate.join(base, "era").select("variant", "era", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("base"), 6).alias("lift"), F.least("n", "base_n").alias("least_n"))


# --- functions and procedures in SQL ------------------------------------------------------------------------------


@query("udf01_sql_scalars", "SELECT p_partkey, round(CASE WHEN p_size > 20 THEN p_size ELSE ln(1 + exp(p_size)) END, 6) AS a, round(ln(p_size + 2) - 0.5 * ln(greatest(p_retailprice / 100, 1 / 1440.0) / (p_size + 2)), 6) AS b, round(greatest(0.05, exp(-(p_retailprice / 50) / least(greatest(20 * ln(p_size + 1) * (1 + 0.5 * tanh(p_size / 7.0)), 14), 365))), 6) AS c, round(0.95 * p_size / 60.0 * 0.8 / (p_size / 60.0 * 0.8 + (1 - p_size / 60.0) * 0.2) + 0.025, 6) AS d FROM part WHERE p_size > 0")
def sql_scalars(spark, sf_dir):
    """The scores called by name from SQL."""
    sql.register(spark)
    return spark.sql("SELECT p_partkey, round(softplus(p_size), 6) AS a, round(actr_activation(p_size, p_retailprice / 100), 6) AS b, round(ebbinghaus_decay(p_size + 1, p_size, p_retailprice / 50), 6) AS c, round(bayesian_update(p_size / 60, 0.8D), 6) AS d FROM {part} WHERE p_size > 0", part=table(spark, sf_dir, "part"))


@query("udf02_associations", f"WITH e AS ({_EDGES}) SELECT p_partkey, dst AS other, round(weight, 9) AS weight, 'out' AS direction FROM e JOIN part ON src = p_partkey WHERE p_partkey % 50 = 0 UNION ALL SELECT p_partkey, src, round(weight, 9), 'in' FROM e JOIN part ON dst = p_partkey WHERE p_partkey % 50 = 0")
def associations(spark, sf_dir):
    """A table function of SQL, called for every fiftieth node."""
    sql.register_edges(spark, graph.fold(_pairs(spark, sf_dir)))
    return spark.sql("SELECT p_partkey, other, round(weight, 9) AS weight, direction FROM {part}, LATERAL get_associations(p_partkey) WHERE p_partkey % 50 = 0", part=table(spark, sf_dir, "part"))


_HIT = "(SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)"


@query("udf03_contradictions", f"SELECT p_partkey AS id, round(CASE WHEN p_partkey IN {_HIT} THEN 0.95 * c * 0.1 / (c * 0.1 + (1 - c) * 0.9) + 0.025 ELSE c END, 6) AS confidence FROM (SELECT *, (p_size + 1) / 60.0 AS c FROM part)")
def contradictions(spark, sf_dir):
    """Confidence after confirmed contradictions."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") + 1) / 60).alias("confidence"))
    pairs = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("old"), F.col("l_suppkey").alias("new"))
    edges = pairs.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("supports").alias("kind"), F.lit(0.5).alias("weight"))
    return consolidate.contradicted(old, edges, pairs)[0].withColumn("confidence", F.round("confidence", 6))


@query("udf03_contradiction_edges", "WITH p AS (SELECT l_suppkey AS new, l_partkey AS old, l_returnflag = 'R' AS hit, l_discount AS w FROM lineitem), b AS (SELECT DISTINCT new, old FROM p WHERE hit) SELECT new AS src, old AS dst, 'supports' AS kind, round(CASE WHEN (new, old) IN (SELECT (new, old) FROM b) OR (old, new) IN (SELECT (new, old) FROM b) THEN w * 0.1 ELSE w END, 6) AS weight FROM p UNION ALL SELECT new, old, 'contradicts', 1.0 FROM b")
def contradiction_edges(spark, sf_dir):
    """Edges after confirmed contradictions."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("new"), F.col("l_partkey").alias("old"), "l_returnflag", "l_discount")
    edges = rows.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("supports").alias("kind"), F.col("l_discount").alias("weight"))
    none = rows.select(F.col("old").alias("id"), F.lit(0.5).alias("confidence")).filter("false")
    return consolidate.contradicted(none, edges, rows.filter("l_returnflag = 'R'"))[1].withColumn("weight", F.round("weight", 6))


@query("mneme_confirm", "SELECT p_partkey, round(CASE WHEN n > 0 THEN 0.95 * c * 0.95 / (c * 0.95 + (1 - c) * 0.05) + 0.025 ELSE c END, 6) AS confidence, p_size + coalesce(n, 0) AS access_count FROM (SELECT *, (p_size + 1) / 60.0 AS c FROM part) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey) ON l_partkey = p_partkey")
def confirm(spark, sf_dir):
    """Recalls that were confirmed: confidence is updated once with evidence 0.95, every use is counted."""
    used = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", ((F.col("p_size") + 1) / 60).alias("c")).join(used, "p_partkey", "left")
    return rows.select("p_partkey", F.round(F.when(F.col("n") > 0, scalars.bayes(F.col("c"), F.lit(0.95))).otherwise(F.col("c")), 6).alias("confidence"), (F.col("p_size") + F.coalesce("n", F.lit(0))).alias("access_count"))
