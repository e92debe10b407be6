"""Event logs in JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import uuid5

EVENT = "type string, sessionId string, timestamp string, cwd string, uuid string, parentUuid string, isSidechain boolean, message struct<content:string>"
#: Content that is a list of blocks; a result's own content is a string or a list again.
BLOCKS = "message struct<content:array<struct<type:string,text:string,thinking:string,name:string,input:string,content:string>>>"
PARTS = "message struct<content:array<struct<content:array<struct<type:string,text:string>>>>>"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: Folders below a session's own whose files are sessions too.
CHILDREN = ("subagents", "tool-results")


def _joined(blocks: Column, text) -> Column:
    """Texts of the blocks that have one, a line each."""
    return F.array_join(F.filter(F.transform(blocks, text), lambda t: t.isNotNull() & (t != "")), "\n")


def _fan_out(value: Column, kind: Column, content: Column) -> Column:
    """The events of a line as an array of ``type, text``: of a user's blocks, each tool result and then what the user said."""
    event = lambda name, text: F.struct(F.lit(name).alias("type"), F.coalesce(text, F.lit("")).alias("text"))
    none = F.array().cast("array<struct<type:string,text:string>>")
    blocks = F.from_json(value, BLOCKS)["message"]["content"]
    parts = F.coalesce(F.from_json(value, PARTS)["message"]["content"], F.array().cast("array<struct<content:array<struct<type:string,text:string>>>>"))
    text = lambda b: F.when(b["type"] == "text", b["text"])
    both = F.zip_with(blocks, parts, lambda b, p: F.struct(b["type"].alias("type"), F.when(p["content"].isNotNull(), _joined(p["content"], text)).otherwise(b["content"]).alias("text")))
    results = F.transform(F.filter(both, lambda b: b["type"] == "tool_result"), lambda b: event("tool_result", b["text"]))
    said = _joined(blocks, lambda b: F.when(b["type"] == "image", "[image]").otherwise(text(b)))
    user = F.when(blocks.isNull(), F.when(content.isNotNull(), F.array(event("user", content))).otherwise(none)).otherwise(F.concat(results, F.when(said != "", F.array(event("user", said))).otherwise(none)))
    use = lambda b: F.concat(F.lit("[tool_use:"), F.coalesce(b["name"], F.lit("")), F.lit(" "), F.coalesce(b["input"], F.lit("")), F.lit("]"))
    told = F.when(blocks.isNull(), content).otherwise(_joined(blocks, lambda b: F.when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "tool_use", use(b)).otherwise(text(b))))
    assistant = F.when(F.translate(told, "\0", "") != "", F.array(event("assistant", told))).otherwise(none)
    return F.when(kind == "user", user).when(kind == "assistant", assistant).when(kind == "system", F.array(event("system", F.lit("")))).otherwise(none)


def _session_ids(lines: DataFrame) -> DataFrame:
    """``file, session_id``: the one id a file's lines agree on, or one made of the file's name and lines.

    Files in a folder of children below a session's get ids of their own, made of that session's and their name. Making an id of the lines
    holds a file in one row; files whose lines agree are not read for it.
    """
    part = lambda i: F.element_at(F.split("file", "/"), i)
    own = F.col("e.sessionId")
    agreed = lines.groupBy("file").agg(F.min(F.when(own != "", own)).alias("a"), F.max(F.when(own != "", own)).alias("b"))
    good = F.coalesce((F.col("a") == F.col("b")) & F.col("a").rlike(UUID), F.lit(False))
    child = part(-2).isin(*CHILDREN) & F.coalesce(F.try_element_at(F.split("file", "/"), F.lit(-3)), F.lit("")).rlike(UUID)
    named = agreed.filter(good).select("file", F.when(child, uuid5(F.col("a"), F.concat(part(-2), F.lit("/"), part(-1)))).otherwise(F.lower("a")).alias("session_id"))
    rest = lines.join(agreed.filter(~good).select("file"), "file", "left_semi")
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    made = rest.groupBy("file").agg(F.sha2(raw, 256).alias("h")).select("file", uuid5(str(uuid.NAMESPACE_OID), F.concat(part(-1), F.lit("|"), F.col("h"))).alias("session_id"))
    return named.unionByName(made)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files below a folder, in order of ``file, pos, n``; bad lines and other types are left out, NULs stripped.

    ``n`` counts the events of one line. An assistant's line without text gives no event, a system's has an empty one. An event without a
    timestamp gets its file's time of change plus a second for each such event before it in the file.
    """
    meta = F.col("_metadata")
    pos = F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("mtime"), pos.alias("pos"), "value")
    lines = lines.filter("value <> ''").withColumn("e", F.from_json("value", EVENT))
    rows = lines.select("file", "mtime", "pos", "e", F.posexplode(_fan_out(F.col("value"), F.col("e.type"), F.col("e.message.content"))).alias("n", "event"))
    ts = F.try_to_timestamp("e.timestamp")
    before = F.sum(ts.isNull().cast("int")).over(Window.partitionBy("file").orderBy("pos", "n")) - 1
    rows = rows.withColumn("ts", F.coalesce(ts, F.timestamp_add("SECOND", before, "mtime"))).join(_session_ids(lines), "file")
    return rows.select("file", "pos", "n", "event.type", "session_id", "ts", F.col("e.cwd").alias("cwd"), F.col("e.uuid").alias("id"), F.col("e.parentUuid").alias("parent_id"), F.coalesce("e.isSidechain", F.lit(False)).alias("is_sidechain"), F.translate("event.text", "\0", "").alias("text"))


def log_sessions(events: DataFrame) -> DataFrame:
    """A row a file: its session, first working folder, start, end (null where it is not after the start) and number of events."""
    rows = events.groupBy("file", "session_id").agg(F.min_by(F.when(F.col("cwd") != "", F.col("cwd")), F.when(F.col("cwd") != "", F.struct("pos", "n"))).alias("cwd"), F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return rows.select("file", "session_id", "cwd", "started", F.when(F.col("last") > F.col("started"), F.col("last")).alias("ended"), "n")


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
