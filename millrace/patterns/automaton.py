"""Patterns with quantifiers, groups and alternation, as an automaton over slices of time.

A pattern is an expression of :func:`row`, :func:`seq`, :func:`either` and :func:`repeat`. It becomes states that wait for a
row. A row that fits is *taken* and leads to the states behind it; a state that is linked loosely *ignores* rows in
between; parts that may be empty are *proceeded* over when the automaton is built. Matches that share rows share
the chain of these rows: a taken row points to the one before it, and a chain is freed with the last match that holds it.

How the first row of a part follows the row before it is the part's ``link``: ``next`` (the very next row), ``followed_by``
(the first later row that fits) or ``followed_by_any`` (every later row that fits).

The match must span less than ``within`` seconds. Time is cut into slices of that width; matches that start in a slice end
in it or in the next one, so that each (key, slice) is worked on by itself, with the rows of two slices read in order. What a
task holds is the open matches of one (key, slice), whatever number of rows a key has. Conditions are evaluated by Spark;
the automaton sees a bit for each.

Rows with a null time take no part. Null keys are one key. An empty table gives no matches. Ties in ``order`` stand in any
order, so that it should end in a column that tells rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import time_bucket

LINKS = ("next", "followed_by", "followed_by_any")
MOST_BITS, MOST_STATES = 62, 1000


@dataclass(frozen=True)
class Part:
    """A part of a pattern; ``link`` says how its first row follows the row before it."""

    link: str = "next"

    def linked(self, link: str) -> Part:
        if link not in LINKS:
            raise ValueError(f"link is one of {LINKS}")
        return replace(self, link=link)


@dataclass(frozen=True)
class Row(Part):
    name: str = ""
    condition: Column | None = None


@dataclass(frozen=True)
class Seq(Part):
    parts: tuple[Part, ...] = ()


@dataclass(frozen=True)
class Either(Part):
    parts: tuple[Part, ...] = ()


@dataclass(frozen=True)
class Repeat(Part):
    part: Part | None = None
    least: int = 1
    most: int | None = None
    inner: str = "next"
    greedy: bool = True
    until: Column | None = None


def row(name: str, condition: Column, link: str = "next") -> Part:
    """One row that fits the condition."""
    return Row(name=name, condition=condition).linked(link)


def seq(*parts: Part, link: str | None = None) -> Part:
    """One part after the other; ``link`` is that of the first part unless given."""
    if not parts:
        raise ValueError("a sequence has parts")
    return Seq(parts=parts).linked(link or parts[0].link)


def either(*parts: Part, link: str = "next") -> Part:
    """One of the parts; where a start gives one match only, an earlier part goes first."""
    if not parts:
        raise ValueError("an alternation has parts")
    return Either(parts=parts).linked(link)


def repeat(
    part: Part, least: int, most: int | None = None, inner: str = "next", greedy: bool = True, until: Column | None = None,
    link: str | None = None,
) -> Part:
    """``least`` to ``most`` rounds of a part (no end if null), ``inner`` linked; ``followed_by_any`` gives all combinations.

    A row that fits ``until`` ends the rounds: once the first round is over, no further round takes it or a row after it.
    """
    if least < 0 or (most is not None and (most < least or most == 0)):
        raise ValueError("rounds are from 0 on, at least one at most")
    if inner not in LINKS:
        raise ValueError(f"inner is one of {LINKS}")
    if _may_be_empty(part):
        raise ValueError("a part that needs no row cannot be repeated")
    return Repeat(part=part, least=least, most=most, inner=inner, greedy=greedy, until=until).linked(link or part.link)


def _may_be_empty(part: Part) -> bool:
    if isinstance(part, Repeat):
        return part.least == 0
    if isinstance(part, Seq):
        return all(_may_be_empty(p) for p in part.parts)
    return isinstance(part, Either) and any(_may_be_empty(p) for p in part.parts)


ACCEPT = (-1, "next", 0)


class Automaton:
    """States (bit of the condition, name, what follows); an edge is (state, link, bits of what closes it)."""

    def __init__(self, pattern: Part):
        self.conditions: list[Column] = []
        self.states: list[tuple[int, str, list]] = []
        self.entry = self._built(pattern, [ACCEPT], "next")
        if ACCEPT in self.entry:
            raise ValueError("a pattern needs a row")

    def _bit(self, condition: Column) -> int:
        for i, known in enumerate(self.conditions):
            if known is condition:
                return i
        self.conditions.append(condition)
        if len(self.conditions) > MOST_BITS:
            raise ValueError(f"a pattern has at most {MOST_BITS} conditions")
        return len(self.conditions) - 1

    def _built(self, part: Part, then: list, link: str, end: int = 0) -> list:
        """Edges into ``part``, most wanted first; ``then`` are the edges behind it, ``end`` the bits that close its own."""
        if isinstance(part, Row):
            if len(self.states) >= MOST_STATES:
                raise ValueError(f"a pattern has at most {MOST_STATES} states")
            self.states.append((self._bit(part.condition), part.name, then))
            return [(len(self.states) - 1, link, end)]
        if isinstance(part, Seq):
            for i in reversed(range(len(part.parts))):
                then = self._built(part.parts[i], then, part.parts[i].link if i else link, end)
            return then
        if isinstance(part, Either):
            return [e for p in part.parts for e in self._built(p, then, link, end)]
        stop = end if part.until is None else end | 1 << self._bit(part.until)

        def order(inner: list, out: list) -> list:
            return inner + out if part.greedy else out + inner

        def round_(i: int, behind: list) -> list:
            return self._built(part.part, behind, link if i == 1 else part.inner, end if i == 1 else stop)

        if part.most is None:
            # a further round leads to where it was chosen from
            loop: list = []
            loop += order(round_(max(part.least, 1) + 1, loop), then)
            behind, last = loop, max(part.least, 1)
        else:
            behind, last = then, part.most
        for i in range(last, 0, -1):
            inner = round_(i, behind)
            behind = inner if i <= part.least else order(inner, then)
        return behind

    def row(self, open_: list, bits: int, at: int, window: int, payload, number: int, starts: bool, every: bool) -> tuple[list, list]:
        """Open matches after a row, and matches that it completes; open ones are [edge, number of the row before, chain, start].

        With ``every`` false an open match stands for its start: what is wanted less, leads to the same state or comes after
        a complete match of its start is let go.
        """
        kept, done, seen, closed = [], [], set(), set()
        fresh = [(e, number, None, (number, at)) for e in self.entry] if starts else []
        for edge, before, chain, start in [*open_, *fresh]:
            state, link, end = edge
            if state < 0:  # a complete match that waits for those of its start that are wanted more
                kept.append((edge, before, chain, start))
                continue
            if at - start[1] >= window or (chain is not None and bits & end):
                continue
            bit, name, then = self.states[state]
            # the first row of a match follows nothing
            reached = chain is None or link != "next" or before == number - 1
            if bits >> bit & 1 and reached:
                grown = (name, payload, chain)
                for e in then:
                    if every and e[0] < 0:
                        done.append((grown, start))
                    else:
                        kept.append((e, number, grown, start))
            if chain is not None and link != "next" and (link == "followed_by_any" or not bits >> bit & 1):
                kept.append((edge, before, chain, start))
        if every:
            return kept, done
        alive = []
        for edge, before, chain, start in kept:
            ident = (start[0], edge, before if edge[1] == "next" else None)
            if start[0] in closed or ident in seen:
                continue
            seen.add(ident)
            alive.append((edge, before, chain, start))
            if edge[0] < 0:  # nothing that is wanted less can win any more
                closed.add(start[0])
        return self.settled(alive)

    @staticmethod
    def settled(open_: list, over: bool = False) -> tuple[list, list]:
        """Complete matches that no open one of their start can outdo, taken out."""
        ahead, left, done = set(), [], []
        for p in open_:
            if p[0][0] < 0 and (over or p[3][0] not in ahead):
                done.append((p[2], p[3]))
            elif not over:
                left.append(p)
                ahead.add(p[3][0])
        return left, done


def _chain(chain) -> list[dict]:
    out = []
    while chain is not None:
        out.append({"stage": chain[0], "row": chain[1]})
        chain = chain[2]
    return out[::-1]


def find(
    df: DataFrame, keys: list[str], order: list[str], pattern: Part, columns: list[str], within: float, every: bool = True
) -> DataFrame:
    """All matches: the keys and ``events``, a list of (stage, row with ``columns``) in order.

    ``order`` begins with the time. With ``every`` false a start row gives one match: rounds as many (greedy) or as few as
    can be, earlier parts of an alternation first, earlier rows first.
    """
    machine, window = Automaton(pattern), int(within * 1_000_000)
    if window < 1:
        raise ValueError("within is a positive number of seconds")
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    bits = F.lit(0).cast("bigint")
    for i, condition in enumerate(machine.conditions):
        bits = bits.bitwiseOR(F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    machine.conditions = []  # they stay with the driver, tasks get the states
    inner = [f"_k{i}" for i in range(len(keys))]
    order_ = [f"_o{i}" for i in range(len(order))]
    rows = df.where(at.isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, inner)],
        *[F.col(o).alias(n) for o, n in zip(order, order_)],
        at.alias("_at"),
        bits.alias("_bits"),
        F.struct(*columns).alias("_row"),
    )
    own = time_bucket(F.col("_at"), window)
    # a row is in its own slice, and in the one before as the end of matches that start there
    rows = rows.withColumn("_own", own).withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    number = F.row_number().over(Window.partitionBy(*inner, "_slice").orderBy(*order_))
    shown = rows.select(*inner, (F.col("_own") == F.col("_slice")).alias("_starts"), "_at", "_bits", "_row", number.alias("_n"))
    event = T.StructType([T.StructField("stage", T.StringType()), T.StructField("row", shown.schema["_row"].dataType)])
    schema = T.StructType([*[shown.schema[n] for n in inner], T.StructField("events", T.ArrayType(event))])
    width = len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []
        key: tuple = ()
        for batch in batches:
            names, kinds = batch.schema.names, [f.type for f in batch.schema]
            events = pa.list_(pa.struct([("stage", pa.string()), ("row", kinds[names.index("_row")])]))
            starts, ats, bits_, numbers = (batch.column(names.index(c)).to_pylist() for c in ("_starts", "_at", "_bits", "_n"))
            payload = batch.column(names.index("_row"))
            found: list[tuple] = []
            for i, n in enumerate(numbers):
                if n == 1:  # another (key, slice)
                    found += [(key, c) for c, _ in machine.settled(open_, over=True)[1]]
                    open_, key = [], tuple(batch.column(j)[i].as_py() for j in range(width))
                if not open_ and not (starts[i] and bits_[i]):
                    continue
                if not every:  # what can no longer grow gives way to the complete matches behind it
                    late = [p for p in open_ if p[0][0] < 0 or ats[i] - p[3][1] < window]
                    open_, done = machine.settled(late)
                    found += [(key, c) for c, _ in done]
                value = payload[i].as_py() if bits_[i] else None
                open_, done = machine.row(open_, bits_[i], ats[i], window, value, n, starts[i], every)
                found += [(key, c) for c, _ in done]
            if found:
                yield _matches(found, kinds[:width], inner, events)
        rest = [(key, c) for c, _ in machine.settled(open_, over=True)[1]]
        if rest:
            yield _matches(rest, kinds[:width], inner, events)

    out = shown.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(inner, keys)], "events")


def _matches(found: list[tuple], kinds: list[pa.DataType], names: list[str], events: pa.DataType) -> pa.RecordBatch:
    keys = [pa.array([k[j] for k, _ in found], kind) for j, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*keys, pa.array([_chain(c) for _, c in found], events)], [*names, "events"])


def rows_of(stage: str, column: str) -> Column:
    """A column of the rows that a match has for a stage, in order."""
    return F.transform(F.filter("events", lambda e: e["stage"] == stage), lambda e: e["row"][column])
