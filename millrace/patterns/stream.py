"""Event patterns on streams: partial matches as keyed state, matches and time-outs as two kinds of output.

Rows wait until the watermark has passed them, so that a key's rows are looked at in event-time order
whatever batch they came with. Stages are single rows linked strictly or relaxed, with negations between
them, as in :class:`millrace.patterns.match.Pattern`; repeats with a fixed number are separate stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.patterns.match import ONCE, Pattern

NEGATED = 32  # a row's bit for the negation before stage i is NEGATED + i; bit i says that it fits stage i
STATE = (
    "at array<bigint>, id array<bigint>, bits array<bigint>, stage array<bigint>, start array<bigint>, "
    "fresh array<boolean>, ids array<string>"
)


class Steps:
    """What one row does to the partial matches of its key."""

    def __init__(self, pattern: Pattern):
        if pattern.pending or any(s.times != ONCE or s.link == "followed_by_any" for s in pattern.stages):
            raise ValueError("a stream pattern has single stages, linked by next or followed_by, and ends in a stage")
        if len(pattern.stages) >= NEGATED:  # the last negation would need the sign of a bigint
            raise ValueError(f"a stream pattern has at most {NEGATED - 1} stages")
        self.links = [s.link for s in pattern.stages]
        self.absent = [s.absent[0] if s.absent else None for s in pattern.stages]
        self.window = None if pattern.window is None else int(pattern.window * 1_000_000)

    def late(self, partials: list, at: int, out: list) -> list:
        """Partial matches that can still be completed by a row at ``at``; the others time out."""
        if self.window is None:
            return partials
        kept = [p for p in partials if at - p[1] < self.window]
        out += [("timeout", p[3], p[1], at) for p in partials if at - p[1] >= self.window]
        return kept

    def row(self, partials: list, at: int, ident: int, bits: int, out: list) -> list:
        """Partial matches (next stage, start, whether the last row was matched, ids) after a row."""
        kept = []
        for stage, start, fresh, ids in self.late(partials, at, out):
            negated = bits >> (NEGATED + stage) & 1
            if negated and (self.absent[stage] == "between" or (self.absent[stage] == "next" and fresh)):
                continue
            if bits >> stage & 1:
                grown = f"{ids},{ident}"
                if stage + 1 == len(self.links):
                    out.append(("match", grown, start, at))
                else:
                    kept.append((stage + 1, start, True, grown))
            elif self.links[stage] != "next":
                kept.append((stage, start, False, ids))
        if bits & 1:
            if len(self.links) == 1:
                out.append(("match", str(ident), at, at))
            else:
                kept.append((1, at, True, str(ident)))
        return kept


def find(stream: DataFrame, key: str, time: str, ident: str, pattern: Pattern) -> DataFrame:
    """(key, kind, ids, start_at, end_at): kind is ``match`` or ``timeout``; ids name the rows of the stages reached.

    The stream has a watermark on ``time``; rows of one time are ordered by ``ident``, a whole number. Times
    are microseconds; a time-out ends at the time that showed it.
    """
    steps = Steps(pattern)
    bits = F.lit(0).cast("bigint")
    for i, stage in enumerate(pattern.stages):
        bits = bits.bitwiseOR(F.when(stage.condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        if stage.absent:
            bits = bits.bitwiseOR(F.when(stage.absent[1], F.lit(1 << (NEGATED + i))).otherwise(F.lit(0)).cast("bigint"))
    rows = stream.select(key, time, F.unix_micros(time).alias("at"), F.col(ident).cast("bigint").alias("id"), bits.alias("bits"))
    kind = dict(stream.dtypes)[key]
    columns = [key, "kind", "ids", "start_at", "end_at"]

    def run(name: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ([], [], [], [], [], [], [])
        waiting = list(zip(*state[:3], strict=True))
        partials = list(zip(*state[3:], strict=True))
        for chunk in [] if held.hasTimedOut else chunks:
            waiting += zip(chunk["at"].tolist(), chunk["id"].tolist(), chunk["bits"].tolist(), strict=True)
        waiting.sort()
        mark, out, done = held.getCurrentWatermarkMs() * 1000, [], 0
        for at, ident_, row_bits in waiting:
            if at > mark:
                break
            partials = steps.row(partials, at, ident_, row_bits, out)
            done += 1
        partials, waiting = steps.late(partials, mark, out), waiting[done:]
        if waiting or partials:
            held.update(tuple(list(c) for c in (*(zip(*waiting) if waiting else [[]] * 3), *(zip(*partials) if partials else [[]] * 4))))
            due = [waiting[0][0]] if waiting else []
            if partials and steps.window is not None:
                due.append(min(p[1] for p in partials) + steps.window)
            if due:
                held.setTimeoutTimestamp(max(min(due) // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame([(name[0], *o) for o in out], columns=columns)

    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, kind string, ids string, start_at bigint, end_at bigint", STATE, "append", GroupStateTimeout.EventTimeTimeout
    ).withColumn("ids", F.transform(F.split("ids", ","), lambda i: i.cast("bigint")))
