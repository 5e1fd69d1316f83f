"""Changes of a path held back until it is quiet: the latest event of each path as state, told by a timer or after so many events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET_MS = 2000
MOST_EVENTS = 32
TOLD = "path string, change string, ts_ms long, event_id long, events int"
_HELD = "change string, ts_ms long, event_id long, events int, due long"


class Latest(StatefulProcessor):
    """Per path the latest event (by time, then id), how many have come since it was last told, and when it is due."""

    def __init__(self, quiet_ms: int = QUIET_MS, most: int = MOST_EVENTS):
        self.quiet_ms, self.most = quiet_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _told(self, key: Any, held: tuple) -> pd.DataFrame:
        change, ts, event, n, due = held
        self.handle.deleteTimer(due)
        self.held.clear()
        return pd.DataFrame({"path": [key[0]], "change": [change], "ts_ms": [ts], "event_id": [event], "events": [n]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        for pdf in rows:
            for change, ts, event in sorted(zip(pdf["change"], pdf["ts_ms"], pdf["event_id"], strict=True), key=lambda x: x[1:]):
                n = held[3] if held else 0
                newest = (change, int(ts), int(event)) if held is None or (int(ts), int(event)) > held[1:3] else held[:3]
                if held:
                    self.handle.deleteTimer(held[4])
                held = (*newest, n + 1, newest[1] + self.quiet_ms)
                if held[3] >= self.most:
                    yield self._told(key, held)
                    held = None
        if held:
            self.held.update(held)
            self.handle.registerTimer(held[4])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = tuple(self.held.get())
            if held[4] <= expiredTimerInfo.getExpiryTimeInMs():
                yield self._told(key, held)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, *, quiet_ms: int = QUIET_MS, most: int = MOST_EVENTS, late: str = "0 seconds") -> DataFrame:
    """A stream of (path, change, ts_ms, event_id, events) from one of (path, change, ts, event_id), with one row per burst of a path: its latest change and how many events it had.

    A burst ends when the watermark (the greatest ts so far less `late`) has passed its
    last event by quiet_ms, or with its `most`-th event. Events later than the watermark
    are dropped by Spark. State is one row per path that is not quiet. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    at = F.col("ts").cast("timestamp")
    rows = events.where("path is not null and ts is not null").select("path", "change", at.alias("ts"), F.unix_millis(at).alias("ts_ms"), F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"))
    return rows.withWatermark("ts", late).groupBy("path").transformWithStateInPandas(statefulProcessor=Latest(quiet_ms, most), outputStructType=TOLD, outputMode="append", timeMode="eventTime")
