"""Reading and writing of sessions and events, retention, and small filters, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import rules, scalars
from strandline.functions.text import has_any
from strandline.operators import sessions

from .registry import query, table

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.tokens(F.col("text")).alias("w"))


# --- sessions and events: a session is a user's events, an order is a record with a state -------------------


@query("src03_newest_first", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderdate IS NOT NULL")
def newest_first(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL").select("o_custkey", "o_orderkey", place.alias("place"))


@query("src04_point_lookup", "SELECT asked, c_name, c_name IS NULL AS missing FROM (SELECT item_id * 20 AS asked FROM benchmark) LEFT JOIN customer ON c_custkey = asked")
def point_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("asked"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asked"), "c_name")
    return asked.join(found, "asked", "left").select("asked", "c_name", F.isnull("c_name").alias("missing"))


@query("src05_append_counters", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def append_counters(spark, sf_dir):
    """Counters of events that arrive in two appends, each folded by itself and then together."""
    events = table(spark, sf_dir, "events")
    parts = [events.filter(c).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")) for c in ("value < 100", "value >= 100 OR value IS NULL")]
    return parts[0].unionByName(parts[1]).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query("src06_session_upsert", "SELECT user_id, min(ts) AS started, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def session_upsert(spark, sf_dir):
    """The newest state of each session; what is set at its start stays."""
    return sessions.merged(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], {"state": "event_type"}, {"started": "ts"})


@query("src07_batch_ingest", "SELECT event_type, count(*) FILTER (WHERE value < 100) AS updated, count(*) FILTER (WHERE NOT coalesce(value < 100, false)) AS inserted FROM events GROUP BY event_type")
def batch_ingest(spark, sf_dir):
    """Events of low value are there already; the batch brings all of them."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    flags = sessions.upsert(events.filter("value < 100"), events, "event_id").filter("inserted IS NOT NULL")
    return flags.groupBy("event_type").agg(F.count_if(~F.col("inserted")).alias("updated"), F.count_if("inserted").alias("inserted"))


@query("src15_import_rest", "SELECT o_orderpriority, count(*) AS imported FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_orderpriority")
def import_rest(spark, sf_dir):
    """What an earlier run has not imported yet, summed up."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("imported"))


@query("src18_first_claim", "SELECT part, orderkey FROM (SELECT l_partkey AS part, l_orderkey AS orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS a FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE a = 1 QUALIFY row_number() OVER (PARTITION BY part ORDER BY orderkey) = 1")
def first_claim(spark, sf_dir):
    """Each order takes its lowest part; of the orders that take one part the first keeps it."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("orderkey"))
    return pairs.groupBy("orderkey").agg(F.min("part").alias("part")).groupBy("part").agg(F.min("orderkey").alias("orderkey"))


@query("src19_link_order", "SELECT o_orderkey, coalesce(r, n, -1) AS link FROM orders LEFT JOIN (SELECT l_orderkey, max(l_partkey) FILTER (WHERE l_returnflag = 'R') AS r, min(l_partkey) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def link_order(spark, sf_dir):
    """The first source that knows a link wins."""
    known = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("r"), F.min(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("n"))
    return table(spark, sf_dir, "orders").join(known, "o_orderkey", "left").select("o_orderkey", F.coalesce("r", "n", F.lit(-1)).alias("link"))


@query("src20_top_comment", "SELECT user_id, arg_max(event_id, (value, ts, event_id)) AS event_id FROM events WHERE value > 0 AND event_type <> 'error' GROUP BY user_id")
def top_comment(spark, sf_dir):
    """Most votes, newest on a tie; none of bots (here errors) and none without votes."""
    return table(spark, sf_dir, "events").filter("value > 0 AND event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "ts", "event_id")).alias("event_id"))


@query("src23_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def last_wins(spark, sf_dir):
    return sessions.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("src32_export", f"SELECT doc_id, to_json({{'doc_id': doc_id, 'lang': lang, 'source': source}}) AS line FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def export(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source")).cast("string").alias("line"))


@query("src33_backup_map", "SELECT event_id, user_id AS was, user_id // 2 AS now FROM events WHERE user_id // 2 <> user_id")
def backup_map(spark, sf_dir):
    """Old and new session of every event that a rewrite will move."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("was"), F.expr("user_id div 2").alias("now")).filter("was <> now")


@query("st02_after_watermark", "SELECT user_id, event_id FROM events JOIN (SELECT user_id, max(event_id) AS mark FROM events WHERE value > 150 GROUP BY 1) USING (user_id) WHERE event_id > mark")
def after_watermark(spark, sf_dir):
    """Events past the last one that each session has handed on (by id, not by time)."""
    events = table(spark, sf_dir, "events")
    return sessions.after_marks(events, events.filter("value > 150").groupBy("user_id").agg(F.max("event_id").alias("mark")), "user_id", "event_id").filter("mark IS NOT NULL").select("user_id", "event_id")


@query("st05_idle_sessions", "SELECT user_id, max(ts) AS ended FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) >= INTERVAL 4 HOURS")
def idle_sessions(spark, sf_dir):
    """Sessions without an event for four hours end at their last one."""
    return sessions.idle(table(spark, sf_dir, "events"), "user_id", "ts", "4 HOURS")


@query("st06_retention", "SELECT user_id FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 1 DAY AND count(*) FILTER (WHERE event_type = 'purchase') = 0")
def retention(spark, sf_dir):
    """Sessions that ended long ago and of which nothing is pending (here purchases) may go."""
    old = sessions.idle(table(spark, sf_dir, "events"), "user_id", "ts", "1 DAY", strict=True)
    pending = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id")
    return old.join(pending, "user_id", "left_anti").select("user_id")


@query("st07_open_or_new", "SELECT c_custkey, user_id IS NULL AS created FROM customer LEFT JOIN (SELECT user_id FROM events GROUP BY 1 HAVING (SELECT max(ts) FROM events) - max(ts) < INTERVAL 4 HOURS) ON user_id = c_custkey")
def open_or_new(spark, sf_dir):
    """Who has an open session goes on with it, others get a new one."""
    events = table(spark, sf_dir, "events")
    open_ = events.select("user_id").distinct().join(sessions.idle(events, "user_id", "ts", "4 HOURS"), "user_id", "left_anti")
    return table(spark, sf_dir, "customer").join(open_, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.isnull("user_id").alias("created"))


@query("st13_archive", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND (SELECT max(o_orderdate) FROM orders) - o_orderdate > INTERVAL 90 DAYS AND o_totalprice < 100000 THEN 'archived' ELSE o_orderstatus END AS state FROM orders")
def archive(spark, sf_dir):
    """Active, unused for ninety days and of low confidence."""
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    stale = (F.col("o_orderstatus") == "O") & (F.col("now") - F.col("o_orderdate") > F.expr("INTERVAL 90 DAYS")) & (F.col("o_totalprice") < 100000)
    return orders.crossJoin(F.broadcast(now)).select("o_orderkey", F.when(stale, "archived").otherwise(F.col("o_orderstatus")).alias("state"))  # one row


@query("fn45_access_counters", "SELECT c_custkey, c_nationkey + coalesce(n, 0) AS accesses, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def access_counters(spark, sf_dir):
    """st16: reads are counted into the stored counter, and the last one is noted."""
    read = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return table(spark, sf_dir, "customer").join(read, "c_custkey", "left").select("c_custkey", (F.col("c_nationkey") + F.coalesce("n", F.lit(0))).alias("accesses"), "last")


# --- filters ------------------------------------------------------------------------------------------------


@query("flt02_active", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def active(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")


@query("flt06_entity_overlap", f"SELECT doc_id FROM documents WHERE list_has_any({_TOK}, ['thint', 'ando'])")
def entity_overlap(spark, sf_dir):
    return _words(spark, sf_dir).filter(has_any(F.col("w"), ["thint", "ando"])).select("doc_id")


@query("flt07_optional", "SELECT doc_id FROM documents WHERE lang = 'en'")
def optional(spark, sf_dir):
    """Of three conditions the two that are not given (null and empty) hold for every row."""
    return table(spark, sf_dir, "documents").filter(sessions.given(lang="en", source=None, text="")).select("doc_id")


@query("flt08_websearch", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS t FROM documents) WHERE (contains(t, ' the ') AND contains(t, ' of the ') AND NOT contains(t, ' and ')) OR contains(t, ' que ')")
def websearch(spark, sf_dir):
    return _words(spark, sf_dir).filter(rules.matches(F.col("w"), 'the "of the" -and OR que')).select("doc_id")


@query("flt10_plain_terms", f"SELECT doc_id FROM documents WHERE list_has_all({_TOK}, ['the', 'of'])")
def plain_terms(spark, sf_dir):
    return _words(spark, sf_dir).filter(rules.matches(F.col("w"), "The of!")).select("doc_id")


@query("flt14_not_superseded", "SELECT o_orderkey FROM orders QUALIFY lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL")
def not_superseded(spark, sf_dir):
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("superseded_by", later).filter("superseded_by IS NULL").select("o_orderkey")


@query("flt16_owner_guard", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 AND o_orderstatus <> 'F' THEN 'deleted' ELSE o_orderstatus END AS state FROM orders")
def owner_guard(spark, sf_dir):
    mine = F.col("o_custkey") % 10 == 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(mine & (F.col("o_orderstatus") != "F"), "deleted").otherwise(F.col("o_orderstatus")).alias("state"))


@query("flt17_confidence_floor", "SELECT c_custkey FROM customer WHERE c_acctbal >= 3000")
def confidence_floor(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal >= 3000").select("c_custkey")


@query("flt18_embedded_turns", "SELECT conv_id, turn FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role IN ('user', 'assistant') AND embedding IS NOT NULL")
def embedded_turns(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant")).join(vectors, "conv_id", "left_semi").select("conv_id", "turn")


@query("flt20_textless", "SELECT doc_id, n_chars AS activation, coalesce(text, '') <> '' AS shown FROM documents")
def textless(spark, sf_dir):
    """Without text a node is not shown, but keeps its activation."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("activation"), (F.coalesce("text", F.lit("")) != "").alias("shown"))


@query("flt21_noise", "SELECT vec_id, label - 1 AS label FROM embeddings WHERE label - 1 >= 0")
def noise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") - 1).alias("label")).filter("label >= 0")


@query("flt25_rejects", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type NOT IN ('view', 'click') OR user_id < 0 OR user_id IS NULL OR value > 400) AS rejected FROM events GROUP BY event_type")
def rejects(spark, sf_dir):
    bad = ~F.col("event_type").isin("view", "click") | (F.col("user_id") < 0) | F.col("user_id").isNull() | (F.col("value") > 400)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("rejected"))


@query("flt26_json_path", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query("flt27_label_and_excerpt", "SELECT doc_id, coalesce(lang, '') || chr(10) || left(coalesce(text, ''), 100) AS content FROM documents WHERE ascii(coalesce(text, '')) >= 0 AND strlen(coalesce(lang, '') || chr(10) || left(coalesce(text, ''), 100)) <= 800")
def label_and_excerpt(spark, sf_dir):
    content = F.concat_ws("\n", F.coalesce("lang", F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(100)))
    return table(spark, sf_dir, "documents").select("doc_id", rules.truncated(content, 800).alias("content"))


@query("flt28_window_or_all", "SELECT e.user_id, event_id FROM events e JOIN (SELECT user_id, max(CASE WHEN ts >= TIMESTAMP '2024-01-02' THEN 1 ELSE 0 END) AS any_in FROM events GROUP BY 1) w ON e.user_id = w.user_id WHERE any_in = 0 OR ts >= TIMESTAMP '2024-01-02'")
def window_or_all(spark, sf_dir):
    """A time window over each user's hits; who has none in it keeps all."""
    inside = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-02'")
    some = F.max(inside.cast("int")).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").withColumns({"some": some, "inside": inside}).filter("some = 0 OR inside").select("user_id", "event_id")


# --- sorts and sets -----------------------------------------------------------------------------------------


@query("top10_oldest_batch", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 64")
def oldest_batch(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(64).select("event_id")


@query("top11_closed_without_vector", "SELECT conv_id, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) LEFT JOIN embeddings ON vec_id = conv_id + 100 WHERE vec_id IS NULL ORDER BY n DESC, conv_id LIMIT 32")
def closed_without_vector(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 100).alias("conv_id"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).join(have, "conv_id", "left_anti").orderBy(F.desc("n"), "conv_id").limit(32)


@query("top12_page", "SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return sessions.paged(table(spark, sf_dir, "customer").orderBy("c_name", "c_custkey"), 20, 40).select("c_custkey")


@query("top13_case_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def case_order(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(tier, "o_orderkey")).alias("place"))


@query("top15_digest_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity DESC, l_linenumber, l_partkey) AS place FROM lineitem")
def digest_order(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", F.desc("l_quantity"), "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


@query("top16_undated_last", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY d IS NULL, d, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS d FROM orders)")
def undated_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")))
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.isnull("d"), "d", "o_orderkey")).alias("place"))


@query("set01_two_pools", "SELECT doc_id, 'quality' AS pool FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def two_pools(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.filter("quality = 1").select("doc_id", F.lit("quality").alias("pool")).unionByName(labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("pool")))


@query("set03_concatenated", "SELECT event_id, 'own' AS tier FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'shared' FROM events WHERE event_type = 'click'")
def concatenated(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.filter("event_type = 'view'").select("event_id", F.lit("own").alias("tier")).unionByName(events.filter("event_type = 'click'").select("event_id", F.lit("shared").alias("tier")))


_MEMBERS = "SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS m FROM lineitem GROUP BY 1"


@query("set05_equal_members", f"SELECT a.l_orderkey AS a, a.l_orderkey + 1 AS b, a.m = b.m AS same FROM ({_MEMBERS}) a JOIN ({_MEMBERS}) b ON b.l_orderkey = a.l_orderkey + 1")
def equal_members(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("m"))
    other = sets.select((F.col("l_orderkey") - 1).alias("a"), F.col("m").alias("n"))
    return sets.withColumnRenamed("l_orderkey", "a").join(other, "a").select("a", (F.col("a") + 1).alias("b"), (F.col("m") == F.col("n")).alias("same"))


@query("set06_all_done", "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def all_done(spark, sf_dir):
    """Whether everything that is expected of a key is among what is completed."""
    orders = table(spark, sf_dir, "orders")
    left = orders.join(orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti").select("o_custkey").distinct().withColumn("open", F.lit(True))
    return orders.select("o_custkey").distinct().join(left, "o_custkey", "left").select("o_custkey", F.isnull("open").alias("done"))


@query("set07_pool_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pool_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


# --- text rules ---------------------------------------------------------------------------------------------


@query("fn06_quoted_query", "SELECT p_partkey, '\"' || replace(p_name, ' ', '\" \"') || '\"' AS q FROM part")
def quoted_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.quoted(F.col("p_name")).alias("q"))


@query("fn08_words", f"SELECT doc_id, {_TOK} AS w FROM documents")
def words(spark, sf_dir):
    return _words(spark, sf_dir)


@query("fn19_closes", r"SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)] AS issues FROM orders")
def closes(spark, sf_dir):
    body = F.concat(F.lit("This Fixes #"), "o_custkey", F.lit(", see #7; prefix #8, resolved  #"), "o_orderkey", F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.closes(body).alias("issues"))


@query("fn20_utc_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("fn31_days", "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN 7 * o_custkey WHEN 2 THEN 30 * o_custkey WHEN 3 THEN 365 * o_custkey END AS INT) AS days FROM orders")
def durations(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, "dwmyh")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.days(F.concat("o_custkey", unit)).alias("days"))


@query("fn32_key_hash", "SELECT c_custkey, sha256('gk_' || c_name) AS hash, left('gk_' || c_name, 8) AS prefix, regexp_full_match('gk_' || c_name, 'gk_[A-Za-z]+#[0-9]{9}') AS valid FROM customer")
def key_hash(spark, sf_dir):
    key = F.concat(F.lit("gk_"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(key, 256).alias("hash"), F.left(key, F.lit(8)).alias("prefix"), key.rlike("^gk_[A-Za-z]+#[0-9]{9}$").alias("valid"))


_FOUND = ", ".join(f"{{'rule': '{name}', 'm': regexp_extract(coalesce(text, ''), '{pattern.replace(chr(39), chr(39) * 2)}')}}" for name, pattern in rules.SECRETS)


@query("fn33_secrets", f"SELECT doc_id, s.rule AS rule, CASE WHEN length(s.m) <= 12 THEN '****' ELSE left(s.m, 4) || '...' || right(s.m, 4) END AS redacted FROM (SELECT doc_id, unnest([{_FOUND}]) AS s FROM documents) WHERE s.m <> ''")
def secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(rules.secrets(F.col("text"))))


@query("fn34_tag_prefix", "SELECT p_partkey, [lower(p_brand), lower(p_type)] AS tags, p_name AS rest FROM part")
def tag_prefix(spark, sf_dir):
    tags, rest = scalars.tags_of(F.concat(F.lit("["), "p_brand", F.lit(" ,, "), "p_type", F.lit("]  "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags"), rest.alias("rest"))


@query("fn38_judge_label", "SELECT o_orderkey, o_orderstatus = 'F' AS yes FROM orders")
def judge_label(spark, sf_dir):
    said = F.element_at(F.create_map(*[F.lit(x) for x in ("F", ' "Yes, it is', "O", "no, yes", "P", "")]), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.says_yes(said).alias("yes"))


@query("fn40_rendered_turns", "SELECT conv_id, left(string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text), 24000) AS body FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id")
def rendered_turns(spark, sf_dir):
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").filter("role IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("t"))
    return turns.select("conv_id", F.left(F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.lit(24000)).alias("body"))
