"""Operators on changelogs: joins and aggregates whose results are taken back when their input is.

A changelog is a stream of rows with ``sign`` (+1 adds a row, -1 takes one back). Results are changelogs with ``op``
(``+`` or ``-``), which :func:`signed` makes an input again and ``keyed.consolidate`` turns into the table
that they stand for. State is kept for parts of the keys (:mod:`parts`), in entries of a bounded size, and holds each
distinct row or value of a key once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.streaming import parts

#: Sides that keep a row without a partner.
PADDED = {"inner": (False, False), "left": (True, False), "right": (False, True), "full": (True, True)}


def signed(log: DataFrame) -> DataFrame:
    """A result changelog as an input: ``op`` as ``sign``."""
    return log.withColumn("sign", F.when(F.col("op") == "+", 1).otherwise(-1)).drop("op")


class Bag:
    """Counted rows of one side of a key with the number of their partners."""

    def __init__(self):
        self.rows: dict[str, tuple[int, int]] = {}

    def put(self, row: str, count: int, partners: int) -> None:
        self.rows[row] = (count, partners)
        if not count:
            del self.rows[row]


class Join(StatefulProcessor):
    """Both sides of a key as bags; each change of one side changes the joined rows and the padded ones."""

    def __init__(self, key: str, kind: str, names: list[str], how: str, match: Callable[[dict, dict], bool] | None):
        self.key, self.kind, self.names, self.padded, self.match = key, kind, names, PADDED[how], match

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.piles = parts.Piles(handle)

    def change(self, bags: list[Bag], side: int, row: str, sign: int, out: list[tuple]) -> None:
        own, other = bags[side], bags[1 - side]
        count, _ = own.rows.get(row, (0, 0))
        if count + sign < 0:
            return  # nothing to take back

        def emit(op: str, mine: str | None, theirs: str | None, times: int) -> None:
            out.extend([(op, mine, theirs) if side == 0 else (op, theirs, mine)] * times)

        body, found = json.loads(row) if self.match else None, []
        for there, held in other.rows.items():
            if self.match is None or (self.match(body, json.loads(there)) if side == 0 else self.match(json.loads(there), body)):
                found.append((there, *held))
        partners = sum(n for _, n, _ in found)
        op = "+" if sign > 0 else "-"
        for there, n, met in found:
            if self.padded[1 - side] and sign > 0 and met == 0:
                emit("-", None, there, n)  # its first partner
            emit(op, row, there, n)
            if self.padded[1 - side] and sign < 0 and met == 1:
                emit("+", None, there, n)  # its last partner has gone
            other.put(there, n, met + sign)
        if self.padded[side] and not partners:
            emit(op, row, None, 1)
        own.put(row, count + sign, partners)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out, touched = next(iter(self.piles.get("held")), {}), [], set()
        batch = pd.concat([parts.unpacked(chunk) for chunk in rows], ignore_index=True).sort_values(["at", "side"], kind="stable")
        changes = zip(parts.identities(batch, self.names), parts.plain(batch[self.key]), *(batch[c].tolist() for c in ("side", "body", "sign")), strict=True)
        for ident, own, side, row, sign in changes:
            touched.add(ident)
            bags = held.setdefault(ident, (Bag(), Bag()))
            found: list[tuple] = []
            self.change(bags, int(side), row, int(sign), found)
            out += [(op, own, left, right) for op, left, right in found]
        for ident in touched:
            if not any(bag.rows for bag in held[ident]):
                del held[ident]
        self.piles.put("held", held or None)
        if out:
            log = pd.DataFrame(out, columns=["op", self.key, "_left", "_right"])
            log[self.key] = parts.column([row[1] for row in out], self.kind)
            yield log

    def close(self) -> None:
        pass


def join(
    left: DataFrame, right: DataFrame, key: str, at: str, how: str = "inner", match: Callable[[dict, dict], bool] | None = None
) -> DataFrame:
    """Unbounded equi-join of two changelogs as a changelog: op, key, the columns of the left, those of the right.

    Both sides have ``key``, ``sign`` and ``at`` (which orders the changes of a key within a micro-batch; the left
    goes first on ties). ``how`` is inner, left, right or full: a row without a partner stands padded with nulls
    until its first partner comes, and again once the last has gone. ``match`` is a further condition on
    the two rows (as dictionaries). Rows to take back that were never added are dropped. Null keys join nothing; they
    must be filtered out before. State holds each distinct row of a key once, a task the rows of
    one part of the keys (:mod:`parts`).
    """
    kind = dict(left.dtypes)[key]
    sides = []
    for side, frame in enumerate((left, right)):
        body = F.to_json(F.struct(*[c for c in frame.columns if c not in (key, at, "sign")]), {"ignoreNullFields": "false"})
        sides.append(frame.select(key, F.col(at).alias("at"), F.col("sign").cast("int").alias("sign"), F.lit(side).alias("side"), body.alias("body")))
    dealt, names = parts.packed(sides[0].unionByName(sides[1]), [key])
    changed = dealt.groupBy(parts.PART).transformWithStateInPandas(
        statefulProcessor=Join(key, kind, names, how, match), outputStructType=f"op string, {key} {kind}, _left string, _right string",
        outputMode="Append", timeMode="None",
    )
    shown = [F.col("op"), F.col(key)]
    for name, frame in (("_left", left), ("_right", right)):
        fields = StructType([f for f in frame.schema.fields if f.name not in (key, at, "sign")])
        shown.append(F.from_json(name, fields).alias(name))
    return changed.select(*shown).select("op", key, "_left.*", "_right.*")


class Aggregate(StatefulProcessor):
    """Reference-counted values of a key, with its least and greatest as a bound that is sought anew only when it goes."""

    COLUMNS = ["n", "total", "low", "high", "distinct_values"]

    def __init__(self, key: str, kind: str, names: list[str]):
        self.key, self.kind, self.names = key, kind, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.piles = parts.Piles(handle)

    @staticmethod
    def change(result: tuple | None, values: dict[float, int], net: list[tuple[float, int]]) -> tuple | None:
        """The result after the changes, which go into ``values``."""
        n, total, low, high, kinds = result or (0, 0.0, None, None, 0)
        lost = False
        for value, change in net:
            held = values.get(value, 0)
            now = held + change
            if now:
                values[value] = now
            else:
                values.pop(value, None)
            # a value that was taken back before it came waits with a negative count
            shown, shows = max(held, 0), max(now, 0)
            n, total = n + shows - shown, total + value * (shows - shown)
            kinds += (shows > 0) - (shown > 0)
            if shows and not shown:
                low, high = (value if low is None else min(low, value)), (value if high is None else max(high, value))
            elif shown and not shows and value in (low, high):
                lost = True
        if lost:
            left = [value for value, count in values.items() if count > 0]
            low, high = min(left, default=None), max(left, default=None)
        return (n, total, low, high, kinds) if n else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out, net, shown = next(iter(self.piles.get("held")), {}), [], {}, {}
        batch = pd.concat([parts.unpacked(chunk) for chunk in rows], ignore_index=True)
        summed = batch.groupby([*dict.fromkeys([*self.names, self.key]), "value"], sort=False, dropna=False)["n"].sum().reset_index()
        summed = summed[summed["n"] != 0]
        for ident, own, value, change in zip(parts.identities(summed, self.names), parts.plain(summed[self.key]), summed["value"].tolist(), summed["n"].tolist(), strict=True):
            net.setdefault(ident, []).append((value, int(change)))
            shown[ident] = own
        for ident, changes in net.items():
            before, values = held.get(ident) or (None, {})
            after = self.change(before, values, changes)
            if after or values:
                held[ident] = (after, values)
            else:
                held.pop(ident, None)
            if after != before:
                out += [("-", shown[ident], *before)] if before else []
                out += [("+", shown[ident], *after)] if after else []
        self.piles.put("held", held or None)
        if out:
            log = pd.DataFrame(out, columns=["op", self.key, *self.COLUMNS])
            log[self.key] = parts.column([row[1] for row in out], self.kind)
            yield log

    def close(self) -> None:
        pass


def aggregate(log: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, least, greatest and number of distinct values of each key, all retractable, as a changelog.

    ``-`` takes back a key's last row, ``+`` gives its new one; a key that falls to nothing is only taken back.
    Null values count in nothing. Changes are added up by (key, value) in every task before the shuffle,
    so that a hot key sends each of its values once. The order of changes does not matter.
    """
    kind = dict(log.dtypes)[key]

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            net = batch.groupby([key, "value"], sort=False, dropna=False)["n"].sum().reset_index()
            yield net[net["n"] != 0]

    rows = log.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("value"), F.col("sign").cast("bigint").alias("n"))
    folded = rows.mapInPandas(combine, f"{key} {kind}, value double, n bigint")
    dealt, names = parts.packed(folded, [key])
    return dealt.groupBy(parts.PART).transformWithStateInPandas(
        statefulProcessor=Aggregate(key, kind, names),
        outputStructType=f"op string, {key} {kind}, n bigint, total double, low double, high double, distinct_values bigint",
        outputMode="Append", timeMode="None",
    )
