"""Keyed state on streams: rolling results, count and delta windows, connected streams, changelogs."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.streaming import parts
from millrace.streaming.eventtime import in_order, released


def keyed(
    stream: DataFrame, keys: list[str], order: list[str], step: parts.Step, output: str, state: str, time: str | None = None
) -> DataFrame:
    """Per key and micro-batch: ``step(key, rows in order, state) -> (rows out, new state)``.

    The rows of one micro-batch and part of the keys (:mod:`parts`) are put in order together, so the read limit of the source
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds what a task holds. ``state`` says what a state is made of; None
    clears the key. With the event time ``time`` rows wait until the watermark has passed them
    (:func:`eventtime.in_order`), so that their order does not depend on the micro-batches.
    """
    if time is not None:
        return in_order(stream, keys[0], time, order, step, output, state)
    return together(stream, keys, order, parts.each_key(step, keys), output)


def together(stream: DataFrame, keys: list[str], order: list[str], work: parts.Work, output: str, time: str | None = None) -> DataFrame:
    """As :func:`keyed`, with ``work`` on the rows of many keys at once."""
    if time is not None:
        return released(stream, keys[0], time, order, work, output)
    dealt, names = parts.packed(stream, keys)

    def run(part: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([parts.unpacked(chunk) for chunk in chunks], ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        out, new = work(rows, pickle.loads(bytes(held.get[0])) if held.exists else None, names)
        if new is None:
            if held.exists:
                held.remove()
        else:
            held.update((pickle.dumps(new, pickle.HIGHEST_PROTOCOL),))
        if out is not None and len(out):
            yield out

    return dealt.groupBy(parts.PART).applyInPandasWithState(run, output, "held binary", "append", GroupStateTimeout.NoTimeout)


def rolling(stream: DataFrame, key: str, order: list[str], value: str, carry: list[str]) -> DataFrame:
    """Count, sum, min and max so far, emitted with every record."""
    kinds = dict(stream.dtypes)
    shown = ", ".join(f"{c} {kinds[c]}" for c in [key, *carry])
    sofar = ["n", "total", "low", "high"]

    def work(rows, state, names):
        # a key's state comes as a row before its own
        begun = None if state is None else state.assign(**{value: np.nan})
        both, code, fresh = parts.by_key(begun, rows[list(dict.fromkeys([*names, key, *carry, value]))], names)
        opens = np.searchsorted(code, code)
        known = ~fresh[opens]
        before = {c: np.where(known, parts.floats(both[c])[opens], first) if state is not None else np.full(len(code), first)
                  for c, first in zip(sofar, (0, 0.0, np.inf, -np.inf), strict=True)}
        group = pd.Series(parts.floats(both[value])).groupby(code)
        least, most = group.cummin().to_numpy(), group.cummax().to_numpy()
        result = {
            "n": np.arange(len(code)) - opens + ~known + before["n"].astype("int64"),
            "total": group.cumsum().to_numpy() + before["total"],
            "low": np.where(least > before["low"], before["low"], least),
            "high": np.where(most < before["high"], before["high"], most),
        }
        out = both[[key, *carry]].assign(**result)
        last = np.flatnonzero(np.searchsorted(code, code, side="right") - 1 == np.arange(len(code)))
        now = both[names].assign(**{c: np.where(fresh, result[c], before[c]) for c in sofar}).iloc[last]
        return out[fresh], now.astype({"n": "int64"})

    return together(stream, [key], order, work, f"{shown}, n bigint, total double, low double, high double")


def counts_while_active(stream: DataFrame, key: str, at: str, carry: list[str], retention: int) -> DataFrame:
    """A running count with every record, begun anew for a key that was idle for more than ``retention``.

    ``at`` is event time in microseconds and the stream has a watermark: the state of an idle key is
    removed once the watermark has passed its last record by ``retention``.
    """
    kinds = dict(stream.dtypes)

    def run(name: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(chunks), ignore_index=True).sort_values([at, *carry], kind="stable", ignore_index=True)
        n, last = held.get if held.exists else (0, None)
        idle = rows[at].diff() > retention
        idle.iloc[0] = last is not None and rows[at].iloc[0] - last > retention
        part = idle.cumsum()
        place = part.groupby(part).cumcount() + 1 + (part == 0) * n
        held.update((int(place.iloc[-1]), int(rows[at].iloc[-1])))
        held.setTimeoutTimestamp(max(int(rows[at].iloc[-1] + retention) // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield rows[[key, *carry]].assign(n=place)

    shown = ", ".join(f"{c} {kinds[c]}" for c in [key, *carry])
    return stream.groupBy(key).applyInPandasWithState(
        run, f"{shown}, n bigint", "n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def count_windows(stream: DataFrame, key: str, order: list[str], value: str, size: int, time: str | None = None) -> DataFrame:
    """A result whenever ``size`` records of a key have arrived (in order of event time, if given); the rest waits in state."""
    kind = dict(stream.dtypes)[key]

    def work(rows, state, names):
        # a key that waits for nothing keeps its number of windows in a row without a value
        columns = list(dict.fromkeys([*names, key, value]))
        both, code, _ = parts.by_key(state, rows[columns].assign(**{"window": 0, "counts": True}), names)
        begun = np.zeros(code[-1] + 1, dtype="int64")
        np.maximum.at(begun, code, both["window"].to_numpy("int64"))
        one = both[columns].iloc[np.searchsorted(code, np.arange(len(begun)))]
        counts = both["counts"].to_numpy(bool)
        both, code = both[counts], code[counts]
        place, full = np.arange(len(code)) - np.searchsorted(code, code), np.bincount(code, minlength=len(begun)) // size
        done = place < full[code] * size
        first = done & (place % size == 0)
        out = pd.DataFrame(
            {
                key: both[key].array[first],
                "window": begun[code[first]] + place[first] // size,
                "total": parts.floats(both[value])[done].reshape(-1, size).sum(axis=1),
            }
        )
        begun += full
        rest = both[~done].assign(window=begun[code[~done]])
        empty = np.setdiff1d(np.arange(len(begun)), code[~done])
        return out, pd.concat([rest, one.iloc[empty].assign(window=begun[empty], counts=False)], ignore_index=True)

    return together(stream, [key], order, work, f"{key} {kind}, window bigint, total double", time)


def delta_windows(
    stream: DataFrame, key: str, order: list[str], at: str, measure: str, best: str, threshold: float, keep_micros: int, time: str | None = None
) -> DataFrame:
    """Delta trigger with a time evictor: when ``measure`` has moved by more than ``threshold`` since the
    last firing, emit the record with the greatest ``best`` among those of the last ``keep_micros``.

    ``at`` is event time in microseconds. Only records still inside the evictor's span stay in state.
    """
    kind = dict(stream.dtypes)[key]

    def work(rows, state, names):
        held, out = state or {}, []
        idents = parts.identities(rows, names)
        for ident, name, t, m, b in zip(idents, parts.plain(rows[key]), rows[at].tolist(), parts.floats(rows[measure]).tolist(), parts.floats(rows[best]).tolist(), strict=True):
            fired_at, times, bests = held.get(ident) or (None, [], [])
            times.append(t)
            bests.append(b)
            if fired_at is None:
                fired_at = m
            elif abs(m - fired_at) > threshold:
                fired_at = m
                live = [i for i, seen in enumerate(times) if seen >= t - keep_micros]
                times, bests = [times[i] for i in live], [bests[i] for i in live]
                top = max(range(len(bests)), key=lambda i: (bests[i], -times[i]))
                out.append((name, t, times[top], bests[top], len(bests)))
            held[ident] = (fired_at, times, bests)
        for ident in set(idents):
            fired_at, times, bests = held[ident]
            live = [i for i, seen in enumerate(times) if seen >= times[-1] - keep_micros]
            held[ident] = (fired_at, [times[i] for i in live], [bests[i] for i in live])
        fired = pd.DataFrame(out, columns=[key, "fired_at", "best_at", "best", "held"])
        fired[key] = parts.column([row[0] for row in out], kind)
        return fired, held

    return together(
        stream, [key], order, work, f"{key} {kind}, fired_at bigint, best_at bigint, best double, held bigint", time
    )


def connect(left: DataFrame, right: DataFrame, key: str, at: str, time: str | None = None) -> DataFrame:
    """Two streams as one tagged stream (key, at, side, body), so that both share the state of their key."""
    kept = [key, at, *([time] if time else [])]
    a = left.select(*kept, F.lit(0).alias("side"), F.to_json(F.struct("*")).alias("body"))
    b = right.select(*kept, F.lit(1).alias("side"), F.to_json(F.struct("*")).alias("body"))
    return a.unionByName(b)


def co_process(
    connected: DataFrame, key: str, first: Callable, second: Callable, output: str, kind: str, time: str | None = None
) -> DataFrame:
    """Shared keyed state: ``first(state, row) -> state`` and ``second(state, row) -> [output tuples]``.

    ``connected`` comes from :func:`connect` with the time column ``at``; the state is one value of type
    ``kind``, None before the first row of the first stream.
    """
    key_kind = dict(connected.dtypes)[key]
    shown = [part.split()[0] for part in output.split(",")]

    def work(rows, state, names):
        held, out = state or {}, []
        for ident, own, side, body in zip(parts.identities(rows, names), parts.plain(rows[key]), rows["side"].tolist(), rows["body"].tolist(), strict=True):
            if side == 0:
                held[ident] = first(held.get(ident), json.loads(body))
            else:
                out += [(own, *values) for values in second(held.get(ident), json.loads(body))]
        found = pd.DataFrame(out, columns=[key, *shown])
        found[key] = parts.column([row[0] for row in out], key_kind)
        return found, {ident: value for ident, value in held.items() if value is not None} or None

    return together(connected, [key], ["at", "side"], work, f"{key} {key_kind}, {output}", time)


def latest_version_join(
    probes: DataFrame, versions: DataFrame, key: str, at: str, probe_id: str, value: str, time: str | None = None
) -> DataFrame:
    """Processing-time temporal join: each probe meets the latest version of its key seen so far.

    Inside one micro-batch arrival order is taken from ``at``; with ``time`` rows wait for the watermark, and arrival is
    in order of event time. Probes without a version are dropped.
    """
    kind = dict(probes.dtypes)
    kept = [key, at, *([time] if time else [])]
    merged = probes.select(*kept, F.lit(1).alias("side"), F.col(probe_id).alias("id"), F.lit(None).cast("double").alias("v"))
    merged = merged.unionByName(
        versions.select(*kept, F.lit(0).alias("side"), F.lit(0).cast(kind[probe_id]).alias("id"), F.col(value).alias("v"))
    )

    def work(rows, state, names):
        both, code, fresh = parts.by_key(state, rows[list(dict.fromkeys([*names, key, "side", "id", "v"]))], names)
        version = both["side"].to_numpy("int64") == 0
        last = np.maximum.accumulate(np.where(version, np.arange(len(code)), -1))
        known = last >= np.searchsorted(code, code)
        met = fresh & ~version & known
        out = both.loc[met, [key, "id"]].rename(columns={"id": probe_id}).assign(**{value: parts.floats(both["v"])[last[met]]})
        ends = np.flatnonzero(np.append(code[1:] != code[:-1], True))
        return out, both.iloc[last[ends[known[ends]]]][[*names, "side", "v"]]

    return together(
        merged, [key], [at, "side"], work, f"{key} {kind[key]}, {probe_id} {kind[probe_id]}, {value} double", time
    )


def changelog(stream: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Grouped count and sum as a changelog: ``-`` with the old row, then ``+`` with the new one.

    ``sign`` is an input column of +1 (add) or -1 (retract); a group that falls to zero is deleted, and a
    retraction for an unknown key is dropped. Nothing is emitted for a group that ends a micro-batch as it was.

    Rows are folded in every task before the shuffle, so a hot key sends one row per task and Arrow batch. A fold of rows in their
    order keeps the net change, how far the count falls on the way, and the sum behind its lowest point:
    a group that gets down to nothing there begins anew, whatever it held. ``order`` names a column that
    orders the rows of a micro-batch; folds follow each other by their first row.
    """
    kind = dict(stream.dtypes)[key]

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows = batch.sort_values(order, kind="stable") if order else batch
            group = rows.groupby(key, sort=False, dropna=False)
            rows = rows.assign(_v=rows[value] * rows["sign"], _n=group["sign"].cumsum(), _place=range(len(rows)))
            group = rows.groupby(key, sort=False, dropna=False)
            rows = rows.assign(_s=group["_v"].cumsum(), _low=group["_n"].transform("min").clip(upper=0))
            group = rows.groupby(key, sort=False, dropna=False)
            out = group.agg(n=("sign", "sum"), total=("_v", "sum"), low=("_low", "first"), place=("_place", "min")).reset_index()
            lowest = rows[rows["_n"] == rows["_low"]].groupby(key, sort=False, dropna=False)["_s"].last().rename("_at").reset_index()
            out = out.merge(lowest, on=key, how="left")
            out["tail"] = out["total"] - out["_at"].fillna(0.0)
            out["first"] = rows.iloc[out["place"]][order].astype("int64").to_numpy() if order else out["place"]
            yield out[[key, "first", "n", "total", "low", "tail"]]

    signed = stream if order is None else stream.withColumn(order, F.col(order).cast("bigint"))
    partial = signed.mapInPandas(combine, f"{key} {kind}, first bigint, n bigint, total double, low bigint, tail double")

    def work(rows, state, names):
        held, before, shown = state or {}, {}, {}
        folds = zip(parts.identities(rows, names), parts.plain(rows[key]), *(rows[c].tolist() for c in ("n", "total", "low", "tail")), strict=True)
        for ident, own, net, added, low, tail in folds:
            if ident not in before:
                before[ident], shown[ident] = held.get(ident), own
            n, total = held.get(ident) or (0, 0.0)
            held[ident] = (int(net - low), float(tail)) if n + low <= 0 else (n + int(net), total + float(added))
        out = []
        for ident, old in before.items():
            new = held[ident] if held[ident][0] > 0 else None
            if new is None:
                del held[ident]
            if new != old:
                out += [("-", shown[ident], *old)] if old else []
                out += [("+", shown[ident], *new)] if new else []
        log = pd.DataFrame(out, columns=["op", key, "n", "total"])
        log[key] = parts.column([row[1] for row in out], kind)
        return log, held or None

    return together(partial, [key], ["first"], work, f"op string, {key} {kind}, n bigint, total double")


def consolidate(log: DataFrame) -> DataFrame:
    """The table a changelog stands for: rows whose additions outnumber their retractions."""
    rest = [c for c in log.columns if c not in ("op", "_batch")]
    sign = F.when(F.col("op") == "+", 1).otherwise(-1)
    net = log.groupBy(*rest).agg(F.sum(sign).alias("_net"))
    return net.where("_net > 0").drop("_net")
