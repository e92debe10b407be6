"""Bundles of issue threads as a Spark data source, and their import with a ledger of what is done.

A bundle is a folder of ``.jsonl`` files, at any depth; a line is a record: a session and its events. ``spark.read.format("bundles").load(path)`` gives a row an event; a file is a partition,
and one line at a time is held.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.streaming.store import Store

EVENT = "file string, line long, session_id string, agent_kind string, cwd string, git_branch string, started_at string, ended_at string, position int, event_id string, type string, kind string, text string, at string, tags array<string>, entities array<string>"
SCHEMA = f"{EVENT}, error string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Events that are handed to Spark at a time.
BATCH = 4096
#: The type of every event (content of a thread is written outside), and the agent of sessions that name none (fixed values).
TYPE, AGENT = "user", "github"


class BadRecord(ValueError):
    """What is wrong with a record, with its file and line."""


def _checked(text: str) -> tuple[dict, list[dict], str]:
    """The session, events and id of a line; raises with what is wrong."""
    try:
        record = json.loads(text)
    except ValueError as e:
        raise BadRecord(f"no JSON: {e}") from e
    session = record.get("session") if isinstance(record, dict) else None
    if not isinstance(session, dict) or not session.get("id"):
        raise BadRecord("session.id is missing")
    try:
        of = str(uuid.UUID(session["id"]))
    except (ValueError, AttributeError, TypeError) as e:
        raise BadRecord(f"session.id {session['id']!r} is no UUID") from e
    events = record.get("events") or []
    if not isinstance(events, list) or not events:
        raise BadRecord("no events")
    for i, e in enumerate(events):
        if not isinstance(e, dict) or not e.get("kind"):
            raise BadRecord(f"events[{i}]: kind is missing")
    return session, events, of


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mode = options.get("path"), options.get("mode", "strict")
        if not self.path:
            raise ValueError("bundles need a path")
        if self.mode not in ("strict", "collect"):
            raise ValueError(f"mode {self.mode!r} is neither strict nor collect")
        self.only: set[str] | None = None
        self.done: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on the session: records of others are passed over before their events are looked at."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if not isinstance(inner, EqualTo | In) or inner.attribute != ("session_id",):
                yield f
                continue
            values = set(inner.value) if isinstance(inner, In) else {inner.value}
            if isinstance(f, Not):
                self.done |= values
            else:
                self.only = values if self.only is None else self.only & values

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, root = self._fs()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".jsonl")]

    def read(self, partition: _File) -> Iterator[tuple]:
        import io

        if partition is None:  # a folder without files
            return
        store, _ = self._fs()
        with store.open_input_stream(partition.path) as raw, io.BufferedReader(raw, 1 << 20) as lines:
            for n, line in enumerate(lines, 1):
                if line.rstrip(b"\r\n"):
                    yield from self._rows(partition.path, n, line)

    def _rows(self, path: str, n: int, line: bytes) -> Iterator[tuple]:
        try:
            session, events, of = _checked(line.decode())
        except (BadRecord, UnicodeDecodeError) as e:
            if self.mode == "strict":
                raise BadRecord(f"{path} line {n}: {e}") from e
            if self.only is None:
                yield (path, n, *[None] * (len(FIELDS) - 3), str(e))
            return
        if of in self.done or (self.only is not None and of not in self.only):
            return
        text = lambda x: None if x is None or x == "" else str(x)
        head = (path, n, of, session.get("agent_kind") or AGENT, text(session.get("cwd")), text(session.get("git_branch")), text(session.get("started_at")), text(session.get("ended_at")))
        for i, e in enumerate(events):
            yield (*head, i, text(e.get("id")), TYPE, e["kind"], e.get("content") or "", text(e.get("created_at")), [str(t) for t in e.get("tags") or []], [str(t) for t in e.get("entities") or []], None)


class _Batches(_Reader):
    """Gives Spark whole batches, whose columns are made at once instead of value by value."""

    def __init__(self, options: dict, schema: StructType) -> None:
        super().__init__(options)
        self.kind = to_arrow_schema(schema)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        rows, kind = super().read(partition), self.kind
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kind.types, strict=True)], schema=kind)


class Bundles(DataSource):
    """``mode`` is ``strict`` (the first bad record fails the read, named by file and line) or ``collect`` (bad records are rows with an ``error``)."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batches(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bundles)


def read(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    register(spark)
    return spark.read.format("bundles").option("mode", mode).load(path)


class Import:
    """Imports bundles into ``path``: each session once, whatever is run again.

    ``events/run=<n>`` holds what a run imported; it counts once the ledger of sessions has the run. A session that stands in several records is imported from the
    first, by file and line. Bad records are counted and stop nothing; records that failed come again in the next run.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path = spark, path
        self.ledger = Store(spark, f"{path}/ledger", "session_id string, run long", ["session_id"], buckets)

    def run(self, source: str, dry: bool = False) -> dict[str, int]:
        """Records seen, imported, done before, repeated and failed, and events imported; a dry run only counts."""
        from strandline.operators.lineage import cut, drop

        n = (self.ledger.batches() or [-1])[-1] + 1
        rows = cut(read(self.spark, source, "collect"))
        records = rows.groupBy("file", "line", "session_id").agg(F.count("*").alias("events"), F.first("error").alias("error"))
        done = self.ledger.read().select("session_id", F.lit(True).alias("done"))
        first = records.filter("error IS NULL").groupBy("session_id").agg(F.min(F.struct("file", "line")).alias("at")).select("session_id", "at.file", "at.line", F.lit(True).alias("own"))
        state = cut(records.join(done, "session_id", "left").join(first, ["session_id", "file", "line"], "left").select("file", "line", "session_id", "events", F.when(F.col("error").isNotNull(), "failed").when(F.col("done"), "done").when(F.col("own"), "imported").otherwise("repeated").alias("state")))
        counts = {r["state"]: (r["n"], r["events"]) for r in state.groupBy("state").agg(F.count("*").alias("n"), F.sum("events").alias("events")).collect()}
        if not dry and "imported" in counts:
            new = state.filter("state = 'imported'")
            rows.drop("error").join(new.select("file", "line"), ["file", "line"], "left_semi").write.mode("overwrite").parquet(f"{self.path}/events/run={n}")
            self.ledger.update(n, new.select("session_id", F.lit(n).cast("long").alias("run")), lambda known, more: known.unionByName(more))
        drop(self.spark, rows, state)
        out = {k: counts.get(k, (0, 0))[0] for k in ("imported", "done", "repeated", "failed")}
        return {"seen": sum(out.values()), **out, "events": counts.get("imported", (0, 0))[1]}

    def events(self) -> DataFrame:
        """Imported events of all runs that count."""
        paths = [f"{self.path}/events/run={n}" for n in self.ledger.batches()]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)
