"""Keyed work in event-time order, window triggers with lateness, marks in the data, rules as a stream.

What these operators give does not depend on how the input is cut into micro-batches, but for rows that come behind the
watermark: what is late is decided by the watermark as it stood when their micro-batch began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming import parts


class Waker(StatefulProcessor):
    """Keeps one timer for each key, at the earliest time asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms bigint")

    def wake(self, ms: int) -> None:
        if self.due.exists():
            now = self.due.get()[0]
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


class InOrder(Waker):
    """Rows of a part wait until the watermark has passed them, then go through ``work`` in order."""

    def __init__(self, work: parts.Work, order: list[str], names: list[str], times: list[str]):
        self.work, self.order, self.names, self.times = work, ["at_us", *order], names, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.piles = parts.Piles(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, new = timerValues.getCurrentWatermarkInMs() * 1000, []
        for chunk in rows:
            chunk = chunk.drop(columns=self.times)
            chunk = chunk[~chunk[f"{parts.NULL}at_us"].astype(bool) & ((chunk["at_us"] >= mark) | (mark <= 0))]
            if len(chunk):
                new.append(parts.unpacked(chunk))
        if new:
            self.piles.add("waiting", pd.concat(new, ignore_index=True))
            self.wake(min(int(chunk["at_us"].min()) for chunk in new) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        rows = pd.concat(self.piles.get("waiting"), ignore_index=True)
        later = rows["at_us"] >= mark
        if later.all():
            self.wake(int(rows["at_us"].min()) // 1000 + 1)
            return
        if later.any():
            self.piles.put("waiting", rows[later])
            self.wake(int(rows["at_us"][later].min()) // 1000 + 1)
        else:
            self.piles.put("waiting", None)
        ready = rows[~later].sort_values(self.order, kind="stable", ignore_index=True)
        out, new = self.work(ready, next(iter(self.piles.get("held")), None), self.names)
        self.piles.put("held", new)
        if out is not None and len(out):
            yield out


def released(stream: DataFrame, key: str, time: str, order: list[str], work: parts.Work, output: str) -> DataFrame:
    """As :func:`in_order`, with ``work`` on the rows of many keys at once."""
    rows = stream.withColumn("at_us", F.unix_micros(time))
    times = [name for name, kind in rows.dtypes if kind.startswith("timestamp")]
    dealt, names = parts.packed(rows, [key])
    return dealt.groupBy(parts.PART).transformWithStateInPandas(
        statefulProcessor=InOrder(work, order, names, times), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def in_order(stream: DataFrame, key: str, time: str, order: list[str], step: parts.Step, output: str, state: str) -> DataFrame:
    """``step(key, rows in order, state) -> (rows out, new state)`` over the rows that the watermark has passed.

    ``stream`` has the event time ``time`` and a watermark; rows are in order of (time, ``order``), rows of one time always
    come together, and rows behind the watermark or without a time are dropped. The rows of a part of the keys (:mod:`parts`) of one
    watermark delay stay in state and are held by a task when they are released. A null key is a key; a key is no timestamp. ``state``
    says what a state is made of; None clears the key. Needs the RocksDB provider.
    """
    return released(stream, key, time, order, parts.each_key(step, [key]), output)


def marked(stream: DataFrame, mark) -> DataFrame:
    """A watermark that rows of the data carry: ``mark`` is a time where a row is a mark, else null.

    The watermark is the greatest mark of the earlier micro-batches, or the least of these among several streams that are
    marked each and then united. ``in_order`` on a time column of the result releases exactly what lies before it.
    """
    return stream.withColumn("mark_at", mark).withWatermark("mark_at", "0 seconds")


# --- frames -----------------------------------------------------------------------------------------------------------


def _extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, pick) -> np.ndarray:
    """Least (or greatest) of each ``values[low:high]``, none of them empty, by doubled spans."""
    out, level, span = np.empty(len(low)), values, 1
    length = high - low
    while True:
        here = (length >= span) & (length < 2 * span)
        out[here] = pick(level[low[here]], level[high[here] - span])
        if not (length >= 2 * span).any():
            return out
        level, span = pick(level[:-span], level[span:]), 2 * span


def framed(values: np.ndarray, low: np.ndarray, high: np.ndarray, code: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Count, sum, min, max and sample deviation of each ``values[low:high]``; values that are null (NaN) do not count.

    ``code`` numbers the keys of sorted rows; no span reaches over two keys. Sums begin anew with every key.
    """
    code = np.zeros(len(values), dtype="int64") if code is None else code
    there = ~np.isnan(values)
    count = np.bincount(code, there)
    centres = np.bincount(code, np.where(there, values, 0.0)) / np.maximum(count, 1)
    centre = centres[code[low]]
    shifted = np.where(there, values - centres[code], 0.0)
    opens = low == np.searchsorted(code, code[low])
    sums = [pd.Series(part).groupby(code).cumsum().to_numpy() for part in (there.astype(float), shifted, shifted * shifted)]
    n, first, second = (part[high - 1] - np.where(opens, 0.0, part[low - 1]) for part in sums)
    some, two = n > 0, n > 1
    spread = np.sqrt(np.maximum(second - first * first / np.maximum(n, 1), 0) / np.maximum(n - 1, 1))
    least = _extremes(np.where(there, values, np.inf), low, high, np.minimum)
    most = _extremes(np.where(there, values, -np.inf), low, high, np.maximum)
    return {
        "n": n.astype("int64"), "total": np.where(some, first + n * centre, np.nan), "low": np.where(some, least, np.nan),
        "high": np.where(some, most, np.nan), "deviation": np.where(two, spread, np.nan),
    }


def over(stream: DataFrame, key: str, time: str, order: list[str], value: str, carry: list[str], rows: int | None = None, micros: int | None = None) -> DataFrame:
    """Count, sum, min, max and deviation of a bounded OVER frame, a row for every row once the watermark has passed it.

    ``rows``: the row and that many before it. ``micros``: all rows of the last so many microseconds, with
    the later rows of the same time. Only rows that a later frame may reach stay in state.
    """
    if (rows is None) == (micros is None):
        raise ValueError("a frame is given by rows or by time")
    kinds = dict(stream.dtypes)
    shown = ", ".join(f"{c} {kinds[c]}" for c in [key, *carry])

    def work(new, state, names):
        both, code, fresh = parts.by_key(state, new[list(dict.fromkeys([*names, key, *carry, "at_us", value]))], names)
        times, values = both["at_us"].to_numpy("int64"), parts.floats(both[value])
        place, end = np.arange(len(code)), np.searchsorted(code, code, side="right")
        if rows is not None:
            low, high = np.maximum(place - rows, np.searchsorted(code, code)), place + 1
            kept = place >= end - rows
        else:
            known, rank = np.unique(times, return_inverse=True)
            ordered = code * (len(known) + 1) + rank
            low = np.searchsorted(ordered, code * (len(known) + 1) + np.searchsorted(known, times - micros))
            high = np.searchsorted(ordered, ordered, side="right")
            kept = times >= times[end - 1] - micros
        out = both.loc[fresh, [key, *carry]].assign(**framed(values, low[fresh], high[fresh], code))
        return out, both.loc[kept, list(dict.fromkeys([*names, "at_us", value]))]

    output = f"{shown}, n bigint, total double, low double, high double, deviation double"
    return released(stream, key, time, order, work, output)


# --- windows with triggers --------------------------------------------------------------------------------------------


class Panes(Waker):
    """One window of a key: its count and sum, how often it fired, and what came since."""

    def __init__(self, size: int, lateness: int, purge: bool, early: bool):
        self.size, self.lateness, self.purge, self.early = size, lateness, purge, early

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "n bigint, total double, firing int, fresh boolean")

    def time(self, timerValues) -> int:
        """The watermark of the windows, in milliseconds: Spark's runs behind it by size and lateness."""
        return timerValues.getCurrentWatermarkInMs() + self.size + self.lateness

    def fire(self, key, n, total, firing) -> pd.DataFrame:
        self.held.update((0, 0.0, firing + 1, False) if self.purge else (n, total, firing + 1, False))
        return pd.DataFrame({"named_key": [key[0]], "start": [key[1]], "firing": [firing], "n": [n], "total": [total]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, end = self.time(timerValues), key[1] + self.size
        if now >= end + self.lateness and timerValues.getCurrentWatermarkInMs() > 0:
            return
        n, total, firing, fresh = self.held.get() if self.held.exists() else (0, 0.0, 0, False)
        if fresh and now >= end:  # the watermark passed the end before these rows came
            yield self.fire(key, n, total, firing)
            n, total, firing, fresh = self.held.get()
        for chunk in rows:
            n, total = n + len(chunk), total + float(chunk["amount"].sum())
        self.held.update((int(n), float(total), int(firing), True))
        if now >= end or self.early:
            yield self.fire(key, int(n), float(total), int(firing))
        self.wake(end - self.size - self.lateness if now < end and not self.early else end - self.size)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        if not self.held.exists():
            return
        now, end = self.time(timerValues), key[1] + self.size
        n, total, firing, fresh = self.held.get()
        if fresh and now >= end:
            yield self.fire(key, n, total, firing)
        if now >= end + self.lateness:
            self.held.clear()
        else:
            self.wake(end - self.size)


def triggered(
    stream: DataFrame, key: str, time: str, value: str, seconds: int, delay: int, lateness: int = 0, purge: bool = False, early: bool = False
) -> DataFrame:
    """(key, start in ms, firing, n, total): tumbling windows that may fire several times.

    A window fires when the watermark (``delay`` seconds behind the greatest time) passes its end, and once more for every
    micro-batch that brings late rows; rows of a window whose end lies ``lateness`` seconds behind the watermark are dropped.
    ``purge`` empties a window when it fires, so that every firing shows its own rows only. ``early`` also fires
    for each micro-batch that brings rows before the end, micro-batches being the ticks of processing time.
    ``stream`` has no watermark yet. State is kept by (key, window) and is gone after the lateness. Needs the RocksDB provider.
    """
    size = seconds * 1000
    kind = dict(stream.dtypes)[key]
    at = F.unix_millis(time)
    rows = stream.withWatermark(time, f"{delay + lateness + seconds} seconds")
    rows = rows.where(F.col(time).isNotNull()).select(parts.named(key).alias("named_key"), (at - F.pmod(at, F.lit(size))).alias("start"), time, F.col(value).cast("double").alias("amount"))
    fired = rows.groupBy("named_key", "start").transformWithStateInPandas(
        statefulProcessor=Panes(size, lateness * 1000, purge, early),
        outputStructType="named_key string, start bigint, firing int, n bigint, total double", outputMode="Append", timeMode="EventTime",
    )
    name = F.when(F.col("named_key") != "", F.substring("named_key", 2, 2**31 - 1)).cast(kind).alias(key)
    return fired.select(name, "start", "firing", "n", "total")


# --- rules as a stream ------------------------------------------------------------------------------------------------


def judged(
    stream: DataFrame, time: str, rule, bar, event, ident: str, value: str, copies: int, span: int = 3600
) -> DataFrame:
    """(ident, rule, bar): each event with every rule that is valid at its time and whose bar its value exceeds.

    ``rule`` is the number of the rule a row sets, else null; ``bar`` its new bar, or null to remove it; ``event`` says
    which rows are judged. Rows are dealt over ``copies`` replicas of the state by their slice of ``span`` seconds, so
    no user or source makes one replica hot. For the slices of others a replica needs only how a rule
    stands at their end: every task sends the last row of a rule and slice on, not each row to each replica.
    A rule holds for events of its own time on. State is the valid rules.
    """
    side = F.when(rule.isNotNull(), 0).when(event, 1).otherwise(2)
    rows = stream.select(
        time, F.unix_micros(time).alias("at"), side.alias("side"), rule.cast("bigint").alias("rule"), bar.cast("double").alias("bar"),
        F.col(ident).cast("bigint").alias("ident"), F.col(value).cast("double").alias("value"),
    )
    slice_of = F.floor(F.col("at") / F.lit(span * 1_000_000)).alias("slice")
    # a row that is neither stays as one row of a replica of its own: it only moves the watermark on
    own = rows.withColumn("replica", F.when(F.col("side") < 2, F.pmod(slice_of, F.lit(copies))).otherwise(F.lit(-1)).cast("bigint"))
    # the filter must not go below the watermark, see run.above_watermark
    rules = rows.where(F.when(F.col(time).isNotNull(), F.col("side") == 0).otherwise(F.lit(False)))
    numbers = rules.select("at", slice_of, "rule", "bar", F.coalesce("ident", F.lit(-1 << 63).cast("bigint")).alias("ident"))

    def newest(rules: pd.DataFrame) -> pd.DataFrame:
        return rules.sort_values(["rule", "slice", "at", "ident"], kind="stable").drop_duplicates(["rule", "slice"], keep="last")

    def passed_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            last = newest(pd.concat([last, batch]) if last is not None else batch)
        if last is None or not len(last):
            return
        # up to the next slice in which the rule changes, or once to every other replica
        following = last["slice"].shift(-1).where(last["rule"].shift(-1) == last["rule"])
        reach = (following - last["slice"]).clip(upper=copies - 1).fillna(copies - 1).astype("int64").to_numpy()
        for begin in range(0, len(last), 1000):
            some, times = last.iloc[begin : begin + 1000], reach[begin : begin + 1000]
            sent = some.iloc[np.repeat(np.arange(len(some)), times)]
            step = np.arange(len(sent)) - np.repeat(np.cumsum(times) - times, times) + 1
            yield sent.assign(replica=(sent["slice"].to_numpy() + step) % copies)[["at", "rule", "bar", "ident", "replica"]]

    sent = numbers.mapInPandas(passed_on, "at bigint, rule bigint, bar double, ident bigint, replica bigint")
    dealt = own.unionByName(sent.withColumn(time, F.timestamp_micros("at")).withColumn("side", F.lit(0)), allowMissingColumns=True).drop("at")

    def step(name, new, state):
        nothing = pd.DataFrame({"ident": pd.array([], dtype="Int64"), "rule": [], "bar": []})
        if name[0] < 0:
            return nothing, None
        valid = state or {}
        rules, events = new[new["side"] == 0], new[new["side"] == 1]
        ids = events["ident"].array
        value_of, at = events["value"].to_numpy("float64"), events.index.to_numpy()
        found, after = [], {}
        changes = {int(number): (mine.index.to_numpy(), mine["bar"].to_numpy("float64")) for number, mine in rules.groupby("rule", sort=False)}
        for number in {**valid, **changes}:
            places, levels = changes.get(number, (np.array([], dtype="int64"), np.array([])))
            levels = np.concatenate([[valid.get(number, np.nan)], levels])
            level = levels[np.searchsorted(places, at)]
            hit = value_of > level
            found.append(pd.DataFrame({"ident": ids[hit], "rule": number, "bar": level[hit]}))
            if not np.isnan(levels[-1]):
                after[number] = float(levels[-1])
        return pd.concat(found, ignore_index=True) if found else nothing, after or None

    judged_rows = in_order(dealt, "replica", time, ["side", "ident"], step, "ident bigint, rule bigint, bar double", "bars map<bigint, double>")
    return judged_rows.withColumnRenamed("ident", ident)
