"""Stateful processors with timers, lists, maps and time-to-live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Inactivity(StatefulProcessor):
    """Counts records per key and reports the key once it has been quiet for ``gap_ms`` of event time.

    Each record pushes the timer on; when the timer fires the count is emitted and the key forgotten.
    """

    def __init__(self, key: str, time: str, gap_ms: int):
        self.key, self.time, self.gap_ms = key, time, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n bigint, latest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, latest = self.held.get() if self.held.exists() else (0, 0)
        before = latest
        for chunk in rows:
            n += len(chunk)
            newest = chunk[self.time].max()
            latest = max(latest, int(pd.Timestamp(newest).tz_localize(None).value // 1_000_000))
        if before:
            self.handle.deleteTimer(before + self.gap_ms)
        self.handle.registerTimer(latest + self.gap_ms)
        self.held.update((n, latest))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, latest = self.held.get()
        self.held.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "latest_ms": [latest]})

    def close(self) -> None:
        pass


def inactivity(stream: DataFrame, key: str, time: str, gap_ms: int) -> DataFrame:
    """Keys that went quiet; needs a watermark on ``time`` and the RocksDB state provider."""
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Inactivity(key, time, gap_ms),
        outputStructType=f"{key} {kind}, n bigint, latest_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


class Sightings(StatefulProcessor):
    """Map state with time-to-live: how often each value was seen per key; idle entries expire."""

    def __init__(self, key: str, value: str, ttl_ms: int):
        self.key, self.value, self.ttl_ms = key, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "n bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for chunk in rows:
            for value, n in chunk[self.value].value_counts().items():
                counts[value] = counts.get(value, 0) + int(n)
        for value, n in counts.items():
            before = self.seen.getValue((value,))[0] if self.seen.containsKey((value,)) else 0
            self.seen.updateValue((value,), (before + n,))
            counts[value] = before + n
        names = sorted(counts)
        yield pd.DataFrame({self.key: [key[0]] * len(names), self.value: names, "n": [counts[v] for v in names]})

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, key: str, value: str, ttl_ms: int) -> DataFrame:
    """Running counts per (key, value) whose idle entries are dropped after ``ttl_ms``."""
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Sightings(key, value, ttl_ms),
        outputStructType=f"{key} {kind}, {value} string, n bigint",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
