"""Sessions as state of a stream: opened by the first event, kept while events follow closely, closed by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(start: np.ndarray, end: np.ndarray, n: np.ndarray, idle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (start, end, events) joined where one begins less than ``idle`` after all before it have ended."""
    order = np.argsort(start, kind="stable")
    start, end, n = start[order], end[order], n[order]
    upto = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] - upto[:-1] >= idle]))
    return start[first], np.maximum.reduceat(end, first), np.add.reduceat(n, first)


class _Sessions(StatefulProcessor):
    """Open sessions of one key as (start, end, events), of which there are about as many as the watermark's delay holds idle times."""

    def __init__(self, idle_ms: int, by: list[str]) -> None:
        self.idle_ms, self.by = idle_ms, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start bigint, end bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = np.array(list(self.open.get()), np.int64).reshape(-1, 3)
        at = np.concatenate([df["event_us"].to_numpy(np.int64) for df in rows])
        start, end, n = joined(np.concatenate([known[:, 0], at]), np.concatenate([known[:, 1], at]), np.concatenate([known[:, 2], np.ones(len(at), np.int64)]), self.idle_ms * 1000)
        yield from self._keep(key, list(zip(start.tolist(), end.tolist(), n.tolist(), strict=True)), timerValues.getCurrentWatermarkInMs())

    def _due(self, end: int) -> int:
        return -(-end // 1000) + self.idle_ms

    def _keep(self, key, known: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """Gives what is over by now and keeps the rest, with one timer for the first that ends; rows that the watermark lets through go on with none that is over."""
        over, rest = [s for s in known if self._due(s[1]) <= now], [s for s in known if self._due(s[1]) > now]
        if rest:
            self.open.put(rest)
            self.handle.registerTimer(min(self._due(s[1]) for s in rest))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({**{b: [k] * len(over) for b, k in zip(self.by, key, strict=True)}, "started": [s[0] for s in over], "ended": [s[1] for s in over], "n": [s[2] for s in over]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = [tuple(s) for s in self.open.get()]
        if known and min(self._due(s[1]) for s in known) <= timerValues.getCurrentWatermarkInMs():
            yield from self._keep(key, known, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, by: list[str], ts: str = "ts", idle: int = 4 * 3600, late: str = "30 minutes") -> DataFrame:
    """``by, started, ended, n`` (microseconds) of the sessions of a stream, once nothing has come for ``idle`` seconds.

    An event goes on with a session whose last activity is less than ``idle`` away, else it opens one. Events may come out of order by up to ``late``: one that falls between two sessions joins them
    if it is near enough to both. Events later than that are dropped. Sessions that are still open at the end stay in the state; a restart from the checkpoint goes on with them.
    Events with a null in ``by`` or without a time are left out. Needs the state store ``PROVIDER``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.dropna(subset=[*by, ts]).select(*by, F.col(ts).cast("timestamp").alias("event_at")).withColumn("event_us", F.unix_micros("event_at")).withWatermark("event_at", late)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "started bigint, ended bigint, n bigint"])
    return rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=_Sessions(idle * 1000, by), outputStructType=schema, outputMode="Append", timeMode="EventTime")
