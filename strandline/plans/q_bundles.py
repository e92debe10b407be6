"""Bundles written from the orders table, read back as a data source and imported in runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.lineage import drop, scratch
from strandline.sources import bundles

from .registry import query, table

_ID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


def _write(spark, sf_dir, path, orders="true"):
    """A record an order: the order itself and its items as events. Orders without items, and those of a status F and a key divisible by 7, are broken records."""
    own = table(spark, sf_dir, "orders").filter(orders)
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey"))).alias("items"))
    event = lambda kind, text, *tags: F.struct(kind.alias("kind"), text.alias("content"), F.array(*tags).alias("tags"))
    lines = F.transform("items", lambda i: event(F.lit("commit"), F.concat(F.lit("part "), i["l_partkey"]), F.concat(F.lit("flag:"), i["l_returnflag"])))
    key = F.col("o_orderkey").cast("string")
    broken = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)
    ident = F.when(broken, F.lit("no uuid")).otherwise(F.concat_ws("-", *(F.substring(F.md5(key), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    session = F.struct(ident.alias("id"), F.col("o_orderdate").cast("string").alias("started_at"), F.col("o_orderpriority").alias("cwd"))
    events = F.when(F.col("items").isNull(), F.array().cast("array<struct<kind:string,content:string,tags:array<string>>>")).otherwise(F.concat(F.array(event(F.lit("issue"), F.concat(F.lit("order "), key), F.lit("type:issue"))), lines))
    own.join(items, "o_orderkey", "left").select(F.to_json(F.struct(session.alias("session"), events.alias("events"))).alias("value")).write.option("lineSep", "\n").text(f"{path}/text")
    # the format's files end in .jsonl
    fs, root = bundles.Store(spark, path, "x int", ["x"])._fs(f"{path}/text")
    for f in fs.listStatus(root):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), f.getPath().suffix(".jsonl"))
    return f"{path}/text"


@query(
    "src14_bundle_events",
    f"""WITH i AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT CASE WHEN bad THEN 'broken' ELSE {_ID.format("CAST(o_orderkey AS VARCHAR)")} END AS session_id, CASE WHEN NOT bad THEN o_orderpriority END AS cwd, CASE WHEN bad THEN count(*) ELSE max(n) + 1 END AS events, CASE WHEN bad THEN 0 ELSE max(returned) END AS returned
FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey % 7 = 0 OR n IS NULL AS bad FROM orders LEFT JOIN i ON k = o_orderkey) GROUP BY bad, CASE WHEN NOT bad THEN o_orderpriority END, CASE WHEN bad THEN 'broken' ELSE {_ID.format("CAST(o_orderkey AS VARCHAR)")} END""",
)
def bundle_events(spark, sf_dir):
    """What the data source reads back of every record, with broken ones counted."""
    rows = bundles.read(spark, _write(spark, sf_dir, scratch(spark, "bundles")), "collect")
    session = F.coalesce("session_id", F.lit("broken"))
    returned = F.count_if(F.array_contains("tags", "flag:R"))
    return rows.groupBy(session.alias("session_id"), "cwd").agg(F.count("*").alias("events"), F.coalesce(returned, F.lit(0)).alias("returned"))


@query(
    "src15_import_runs",
    """WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 7 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS bad FROM orders)
SELECT 1 AS run, count(*) FILTER (WHERE NOT bad) AS imported, 0 AS done, count(*) FILTER (WHERE bad) AS failed FROM o WHERE o_orderkey % 2 = 0
UNION ALL SELECT 2, count(*) FILTER (WHERE NOT bad AND o_orderkey % 2 = 1), count(*) FILTER (WHERE NOT bad AND o_orderkey % 2 = 0), count(*) FILTER (WHERE bad) FROM o
UNION ALL SELECT 3, 0, count(*) FILTER (WHERE NOT bad), count(*) FILTER (WHERE bad) FROM o""",
)
def import_runs(spark, sf_dir):
    """Half of the orders' bundles, then all of them, then all again: sessions that are there are passed over, broken records counted each time."""
    paths, found = [scratch(spark, x) for x in ("half", "all", "import")], []
    work = bundles.Import(spark, paths[2])
    for path, orders, runs in ((paths[0], "o_orderkey % 2 = 0", 1), (paths[1], "true", 2)):
        source = _write(spark, sf_dir, path, orders)
        found += [work.run(source) for _ in range(runs)]
        drop(spark, path)  # one set of bundles at a time
    drop(spark, paths[2])
    return spark.createDataFrame([(i, r["imported"], r["done"], r["failed"]) for i, r in enumerate(found, 1)], "run int, imported long, done long, failed long")
