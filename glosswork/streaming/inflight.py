"""Requests in flight: a request is taken up unless one of its key is still under way.

A completion ends what is under way, and so does silence: a key of which nothing came for `within` is forgotten. Events of a
key count in order of time, then of id; a completion of nothing is nothing. Streams keep one small state a key,
which a completion deletes and a timer of event time clears; batches look one event back. Null keys are one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "event_id long, request_key string, ts timestamp"


class InFlight(StatefulProcessor):
    """Rows of request_key, event_id, ts, done; gives the requests that are taken up."""

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _silence(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for at, done in zip((every["ts"].astype("datetime64[ns]").astype("int64") // 1_000).tolist(), every["done"].tolist(), strict=True):
            taken.append(not done and (last is None or at - last > self.within_ms * 1000))
            last = None if done else at
        self._silence()
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.within_ms + 1)
        yield every.loc[taken, ["event_id", "request_key", "ts"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _rows(events: DataFrame, key: Column, time: Column, event_id: Column, done: Column) -> DataFrame:
    return events.select(key.cast("string").alias("request_key"), event_id.cast("long").alias("event_id"), time.alias("ts"), F.coalesce(done, F.lit(False)).alias("done"))


def taken_up(events: DataFrame, key: Column, time: Column, event_id: Column, done: Column, within_ms: int) -> DataFrame:
    """event_id, request_key, ts of the requests that are taken up. Streams need the RocksDB state store, and events later than `within` are dropped."""
    rows = _rows(events, key, time, event_id, done)
    if events.isStreaming:
        keyed = rows.withWatermark("ts", f"{within_ms} milliseconds").groupBy("request_key")
        return keyed.transformWithStateInPandas(InFlight(within_ms), RESULT, "Append", "EventTime")
    order = Window.partitionBy("request_key").orderBy("ts", "event_id")
    before, ended = F.lag("ts").over(order), F.lag("done").over(order)
    silent = F.unix_micros("ts") - F.unix_micros(before) > within_ms * 1000
    return rows.withColumn("free", before.isNull() | ended | silent).filter(F.col("free") & ~F.col("done")).select("event_id", "request_key", "ts")
