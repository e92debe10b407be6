"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, fim, langid, reshard, secret_scan, vector_codes, warc
from .common import scratch, table
from .decontaminate import contaminated, digest
from .exact_dedup import exact_classes
from .near_dedup import near_classes
from .pack import pack_texts
from .substrings import passages
from .token_counts import count_edits

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _op(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("text")} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cand AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, cand.n, i, item_id FROM cand JOIN win ON cand.s = win.s AND cand.n = win.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


@_op("op3_decontaminate", OP3_SQL)
def op3(spark, sf_dir):
    return digest(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@_op("op9_near_dedup")
def op9(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents")).drop("node")


OP5_SQL = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY t, doc_id) = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) JOIN g USING (t)
"""


@_op("op5_exact_dedup", OP5_SQL)
def op5(spark, sf_dir):
    return exact_classes(table(spark, sf_dir, "documents"))


@_op("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, langid.learnable()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_op("op10_pack")
def op10(spark, sf_dir):
    return pack_texts(table(spark, sf_dir, "documents"))


_ESC = "coalesce({0}, '')"
for _code, _plain in chat.ESCAPES:
    _ESC = f"replace({_ESC}, '{_plain}', '{_code}')"

OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length({_ESC.format("text")}) + length(replace({_ESC.format("role")}, chr(10), '~8')) + {len(chat.OPEN) + len(chat.END) + 1} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@_op("op2_chat_format", OP2_SQL)
def op2(spark, sf_dir):
    """Turns reach the operator as records of four layouts, by turn number; their fingerprints tell which."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.sql(f"SELECT -1L, 0L, 'user', '{said}' UNION ALL SELECT -1L, 1L, 'assistant', '{said}'"))
    records = chat.canonical(chat.records_of(rows))
    return chat.digest(chat.read_back(chat.render(chat.turns_of(records))))


OP4_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest, CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""


@_op("op4_warc", OP4_SQL)
def op4(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_op("op6_reshard")
def op6(spark, sf_dir):
    """Documents that lie by source in 24 shards, of which one holds most, go to 24 shards of equal counts."""
    docs = table(spark, sf_dir, "documents").withColumn("old_shard", F.pmod(F.xxhash64("source"), F.lit(24)).cast("int"))
    kept, _ = reshard.rewrite(docs, "old_shard", scratch(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return kept.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@_op("op7_substring_dedup")
def op7(spark, sf_dir):
    return passages(table(spark, sf_dir, "documents"))


@_op("op8_token_counts")
def op8(spark, sf_dir):
    """Counts before and after three edits of each document: a cut start, a new phrase at a quarter, a changed middle."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(s).alias("text"))
    edits = F.array(edit(F.lit(0), F.lit(1), ""), edit(F.floor(n / 4), F.floor(n / 4), " as it was said"), edit(F.floor(n / 2), F.floor(n / 2) + 5, "X"))
    return count_edits(table(spark, sf_dir, "documents").withColumn("edits", edits), edits="edits")


_WORDS_11 = r"CAST(len(regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS BIGINT)"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, {_WORDS_11.format("t")} AS n_words,
       CASE WHEN form <> 'plain' THEN {_WORDS_11.format("substring(t, 1, b)")} - {_WORDS_11.format("pre")} END AS middle_words,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@_op("op11_fill_in_middle", OP11_SQL)
def op11(spark, sf_dir):
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def _op12_sql(rounds: int = 6) -> str:
    """Assignments and means, a pair of tables a round; parts and positions come from the length of the vectors."""
    out = """
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
              WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, (i - 1) // (d // 8) AS part, (i - 1) % (d // 8) AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS c
      FROM (SELECT r, embedding, len(embedding) AS d, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
b0 AS (SELECT part, r - 1 AS entry, pos, c FROM v WHERE r <= 16)"""
    assign = """,
a{1} AS (SELECT r, part, min(e).entry AS entry, min(e).d AS d FROM (SELECT r, part, {{'d': CAST(sum((v.c - b.c) * (v.c - b.c)) AS BIGINT), 'entry': entry}} AS e FROM v JOIN b{0} b USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part)"""
    mean = """,
b{1} AS (SELECT part, entry, pos, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN (
         SELECT part, entry, pos, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM v JOIN a{1} USING (r, part) GROUP BY part, entry, pos) m USING (part, entry, pos))"""
    for n in range(rounds):
        out += assign.format(n, n + 1) + mean.format(n, n + 1)
    out += assign.format(rounds, rounds + 1)
    return f"""{out},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds + 1} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


@_op("op12_vector_codes", _op12_sql())
def op12(spark, sf_dir):
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


@_op("op13_secret_scan")
def op13(spark, sf_dir):
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))
