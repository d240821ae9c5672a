"""Event-time as-of joins on streams: each probe meets the version that was valid at its own time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from millrace.streaming import parts
from millrace.streaming.eventtime import Waker

PROBE, VERSION = 1, 0


class AsOf(Waker):
    """Versions and waiting probes of a part of the keys; probes are answered once the watermark has passed them.

    Then no earlier version can come any more. Of the versions behind the watermark only the last of a key is kept.
    """

    def __init__(self, key: str, ident: str, value: str, outer: bool, names: list[str], times: list[str]):
        self.key, self.ident, self.value, self.outer, self.names, self.times = key, ident, value, outer, names, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.piles = parts.Piles(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for chunk in rows:
            chunk = chunk[chunk["side"].notna()].drop(columns=self.times)
            if len(chunk):
                new.append(parts.unpacked(chunk).astype({"side": "int64"}))
        if new:
            self.piles.add("held", pd.concat(new, ignore_index=True))
            self.wake(min(int(chunk["at"].min()) for chunk in new) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        rows = pd.concat(self.piles.get("held"), ignore_index=True)
        # a later version of the same time replaces the earlier one; versions come before probes of their time
        rows, code, _ = parts.by_key(None, rows.sort_values(["at", "side"], kind="stable", ignore_index=True), self.names)
        at, version = rows["at"].to_numpy("int64"), rows["side"].to_numpy() == VERSION
        last = np.maximum.accumulate(np.where(version, np.arange(len(code)), -1))
        known = last >= np.searchsorted(code, code)
        answered = ~version & (at < mark)
        met = answered if self.outer else answered & known
        since = np.where(known, last, 0)[met]
        out = rows.loc[met, [self.key]].assign(**{
            self.ident: rows["id"][met], "at": at[met], self.value: np.where(known[met], parts.floats(rows["value"])[since], np.nan),
            "version_at": pd.arrays.IntegerArray(at[since], ~known[met])})
        # the last version behind the watermark, and all that is not behind it
        past = np.where(version & (at < mark), np.arange(len(code)), -1)
        newest = np.zeros(code[-1] + 1, dtype="int64") - 1
        np.maximum.at(newest, code, past)
        kept = at >= mark
        kept[newest[newest >= 0]] = True
        self.piles.put("held", rows[kept] if kept.any() else None)
        if (at >= mark).any():
            self.wake(int(at[at >= mark].min()) // 1000 + 1)
        if len(out):
            yield out


def tagged(stream: DataFrame, key: str, time: str, probe, version, ident: str, value: str) -> DataFrame:
    """Rows of one stream as probes and versions by two conditions; other rows only move the watermark on."""
    side = F.when(version, VERSION).when(probe, PROBE)
    return stream.select(key, time, side.alias("side"), F.unix_micros(time).alias("at"), F.col(ident).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"))


def as_of_join(rows: DataFrame, key: str, ident: str = "id", value: str = "value", how: str = "inner") -> DataFrame:
    """(key, ident, at, value, version_at): each probe with the last version of its key at or before its time.

    ``rows`` have the columns of :func:`tagged` and a watermark; two streams are tagged each and united. Order of
    arrival does not matter within the watermark's delay. Probes without a version are dropped, or kept with
    nulls (``how="left"``); a later version of the same time replaces the earlier one. Needs the RocksDB provider.
    """
    if how not in ("inner", "left"):
        raise ValueError("an as-of join is inner or left")
    kind = dict(rows.dtypes)[key]
    times = [name for name, type_ in rows.dtypes if type_.startswith("timestamp") and name != key]
    dealt, names = parts.packed(rows, [key])
    return dealt.groupBy(parts.PART).transformWithStateInPandas(
        statefulProcessor=AsOf(key, ident, value, how == "left", names, times),
        outputStructType=f"{key} {kind}, {ident} bigint, at bigint, {value} double, version_at bigint",
        outputMode="Append", timeMode="EventTime",
    )
