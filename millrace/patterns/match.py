"""Event patterns as ordered relational steps.

A pattern is a list of stages. Working back from the last stage, every row gets the match of the rest
of the pattern that starts at it (or null): the next row is a lead, the next fitting row is the first
non-null value after it, and a repeated stage is a run of fitting rows reduced to one row. These steps
run on ordered slices, so a hot key is spread over many tasks and no key is held in memory.

Every start row has one match; ``followed_by_any`` links give all of them and need ``within``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import joins, ordered
from millrace.scratch import written, written_and_measured

ONCE, OPTIONAL, PLUS, STAR = "", "?", "+", "*"


@dataclass(frozen=True)
class Stage:
    name: str
    condition: Column
    link: str = "next"
    times: str = ONCE
    greedy: bool = True
    absent: tuple[str, Column] | None = None


@dataclass(frozen=True)
class Pattern:
    """``Pattern.begin("a", cond).followed_by("b", cond).within(3600)``."""

    stages: tuple[Stage, ...] = ()
    window: float | None = None
    pending: tuple[str, Column] | None = field(default=None)

    @staticmethod
    def begin(name: str, condition: Column, times: str = ONCE) -> Pattern:
        return Pattern()._add(name, condition, "next", times)

    def _add(self, name: str, condition: Column, link: str, times: str = ONCE, greedy: bool = True) -> Pattern:
        if any(s.name == name for s in self.stages):
            raise ValueError(f"stage {name} is there already")
        if times not in (ONCE, OPTIONAL, PLUS, STAR):
            raise ValueError("times is one of '', '?', '+', '*'")
        if times in (PLUS, STAR, OPTIONAL) and link != "next":
            raise ValueError("a repeated or optional stage follows strictly")
        return replace(
            self, stages=(*self.stages, Stage(name, condition, link, times, greedy, self.pending)), pending=None
        )

    def next(self, name: str, condition: Column, times: str = ONCE, greedy: bool = True) -> Pattern:
        """The very next row (strict)."""
        return self._add(name, condition, "next", times, greedy)

    def followed_by(self, name: str, condition: Column) -> Pattern:
        """The first later row that fits (relaxed)."""
        return self._add(name, condition, "followed_by")

    def followed_by_any(self, name: str, condition: Column) -> Pattern:
        """Every later row that fits."""
        return self._add(name, condition, "followed_by_any")

    def not_next(self, condition: Column) -> Pattern:
        """The very next row must not fit; the following stage is then linked as usual."""
        return replace(self, pending=("next", condition))

    def not_followed_by(self, condition: Column) -> Pattern:
        """No such row before the following (relaxed) stage."""
        return replace(self, pending=("between", condition))

    def times(self, count: int, consecutive: bool = False) -> Pattern:
        """Repeat the last stage ``count`` times in all, as stages name_2, name_3, ..."""
        last, out = self.stages[-1], self
        for i in range(2, count + 1):
            step = out.next if consecutive else out.followed_by
            out = step(f"{last.name}_{i}", last.condition)
        return out

    def group(self, other: Pattern, link: str = "followed_by") -> Pattern:
        """Append another pattern's stages, its first one linked by ``link``."""
        first, *rest = other.stages
        out = self._add(first.name, first.condition, link, first.times, first.greedy)
        return replace(out, stages=(*out.stages, *rest), window=self.window or other.window)

    def within(self, seconds: float) -> Pattern:
        """The match must span less than ``seconds``."""
        return replace(self, window=seconds)


def _spot(columns: list[str]) -> Column:
    return F.struct(F.col("_idx").alias("idx"), *[F.col(c) for c in columns])


def _stage_value(first: Column, last: Column, n: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"), n.cast("bigint").alias("n"))


def find(
    df: DataFrame, keys: list[str], order: list[str], pattern: Pattern, columns: list[str], time: str | None = None
) -> DataFrame:
    """All matches: keys, one struct per stage (first row, last row, count), ``start_idx`` and ``end_idx``.

    ``columns`` are kept for the first and last row of each stage. An optional stage that is skipped is
    null.
    """
    if pattern.pending and pattern.pending[0] == "between":
        raise ValueError("not_followed_by needs a stage after it")
    if pattern.window is not None and time is None:
        raise ValueError("within needs the time column")
    stages = pattern.stages
    late = [s.name for s in stages[1:] if s.times in (PLUS, STAR) and s.greedy]
    if pattern.window is not None and (late or (stages[0].times == STAR and stages[0].greedy)):
        raise ValueError(f"with a time limit a greedy repeated stage opens the pattern, once or more: {late}")
    anywhere = [i for i, s in enumerate(stages) if s.link == "followed_by_any"]
    if anywhere:
        return _find_any(df, keys, order, pattern, columns, time, anywhere[-1])
    needed = sorted({*columns, *( [time] if time else [])})
    flags = [s.condition.alias(f"_c{i}") for i, s in enumerate(stages)]
    flags += [s.absent[1].alias(f"_n{i}") for i, s in enumerate(stages) if s.absent]
    if pattern.pending:
        flags.append(pattern.pending[1].alias("_n_end"))
    rows = df.select(*keys, *[c for c in dict.fromkeys([*order, *needed]) if c not in keys], *flags)
    sliced = ordered.slice_rows(rows, keys, order)
    state = written(ordered.numbered(sliced, keys, order, "_idx", sliced=True), "numbered")
    tail = None
    for i in reversed(range(len(stages))):
        state = written(_back(state, keys, order, pattern, i, needed, tail, time), "stage")
        tail = f"_t{i}"
    found = state.where(F.col("_t0").isNotNull())
    return _finish(found, keys, pattern, "_t0", time)


def _finish(found: DataFrame, keys: list[str], pattern: Pattern, column: str, time: str | None) -> DataFrame:
    names = [s.name for s in pattern.stages]
    out = found.select(*keys, *[F.col(f"{column}.{n}").alias(n) for n in names])
    starts = F.coalesce(*[F.col(f"{n}.first.idx") for n in names])
    ends = F.coalesce(*[F.col(f"{n}.last.idx") for n in reversed(names)])
    out = out.withColumn("start_idx", starts).withColumn("end_idx", ends)
    if pattern.window is not None:
        if time is None:
            raise ValueError("within needs the time column")
        begin = F.coalesce(*[F.unix_micros(F.col(f"{n}.first.{time}").cast("timestamp")) for n in names])
        for stage in reversed(pattern.stages[1:]):  # a last stage that needs no row is left out if it comes too late
            if stage.times not in (OPTIONAL, STAR):
                break
            late = F.unix_micros(F.col(f"{stage.name}.last.{time}").cast("timestamp")) - begin >= int(pattern.window * 1_000_000)
            out = out.withColumn(stage.name, F.when(~F.coalesce(late, F.lit(False)), F.col(stage.name)))
        out = out.withColumn("end_idx", ends)
        end = F.coalesce(*[F.unix_micros(F.col(f"{n}.last.{time}").cast("timestamp")) for n in reversed(names)])
        out = out.where(end - begin < int(pattern.window * 1_000_000))
    return out


def _joined(value: Column, stages, i: int, tail: Column | None) -> Column:
    """The match of stages i.. from the value of stage i and the match of the stages after it."""
    rest = [tail[s.name].alias(s.name) for s in stages[i + 1 :]]
    return F.struct(value.alias(stages[i].name), *rest)


def _back(state: DataFrame, keys, order, pattern: Pattern, i: int, columns, tail: str | None, time: str | None) -> DataFrame:
    """Add ``_t{i}``: the match of stages i.. that starts at the row itself."""
    stages = pattern.stages
    stage, rows = stages[i], state
    spot, fits = _spot(columns), F.col(f"_c{i}")
    if tail is None:
        after = F.lit(True)
        rest = None
        if pattern.pending:  # the row after the last stage must not fit
            rows = ordered.following(rows, keys, order, {"_no": "_n_end"}, sliced=True)
            rows = rows.withColumn("_after", ~F.coalesce("_no", F.lit(False))).drop("_no")
            after = F.col("_after")
    else:
        rows = _link(rows, keys, order, stages, i + 1, tail)
        if pattern.pending is None and all(s.times in (OPTIONAL, STAR) and s.absent is None for s in stages[i + 1 :]):
            # no stage that is left needs a row: the match may end here
            kind = rows.schema["_after"].dataType
            empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
            rows = rows.withColumn("_after", F.coalesce("_after", empty) if stages[i + 1].greedy else empty)
        after, rest = F.col("_after").isNotNull(), F.col("_after")
    if stage.times in (ONCE, OPTIONAL):
        once = F.when(fits & after, _joined(_stage_value(spot, spot, F.lit(1)), stages, i, rest))
        if stage.times == OPTIONAL and tail is not None:
            none = F.lit(None).cast(_value_type(rows, spot))
            skip = F.when(F.col(tail).isNotNull(), _joined(none, stages, i, F.col(tail)))
            once = F.coalesce(once, skip)
        return rows.withColumn(f"_t{i}", once).drop("_after")
    # A run of fitting rows: its last (or first) row with a continuation closes the stage.
    marked = ordered.previous(rows, keys, order, {"_was": f"_c{i}"}, sliced=True)
    marked = marked.withColumn("_starts", F.when(fits & F.coalesce("_was", F.lit(False)), 0).otherwise(1))
    marked = written(ordered.running(marked, keys, order, {"_run": ("sum", "_starts")}, sliced=True), "runs")
    good = marked.where(fits & after).select(
        *keys, "_run", F.col("_idx").alias("_close"), F.struct(spot.alias("last"), (rest if rest is not None else F.lit(None).cast("boolean")).alias("rest")).alias("_end")
    )
    if stage.greedy and pattern.window is not None:
        # the last row of the run whose match ends in time: later rows of a run end later
        def micros(c):
            return F.unix_micros(c.cast("timestamp"))

        last = [F.col(f"_end.rest.{s.name}.last.{time}") for s in reversed(stages[1:])] if rest is not None else []
        ends = good.withColumn("_at", micros(F.coalesce(*last, F.col(f"_end.last.{time}"))))
        limit = int(pattern.window * 1_000_000)
        shape = F.struct(F.col("_close").alias("close"), F.col("_end").alias("end"))
        history = ends.select(*keys, "_run", "_at", F.lit(0).alias("_side"), F.col("_close").alias("_tie"), shape.alias("_pick"))
        probes = marked.withColumn("_at", micros(F.col(time)) + limit).withColumn("_side", F.lit(-1)).withColumn("_tie", F.col("_idx"))
        probes = probes.withColumnRenamed(ordered.SLICE, "_own_slice")
        both = ordered.latest_seen(
            probes.unionByName(history, allowMissingColumns=True), [*keys, "_run"], ["_at", "_side", "_tie"], "_pick", "_last"
        ).where("_side = -1").drop("_pick", "_at", "_side", "_tie").withColumnRenamed("_own_slice", ordered.SLICE)
        both = both.withColumn("_close", F.col("_last.close")).withColumn("_end", F.col("_last.end")).drop("_last")
        usable = fits & F.col("_close").isNotNull() & (F.col("_idx") <= F.col("_close"))
        both = written(both, "bounded")
    elif stage.greedy:
        ends = good.groupBy(*keys, "_run").agg(F.max("_close").alias("_close"), F.max_by("_end", "_close").alias("_end"))
        both = marked.join(ends, [*keys, "_run"], "left")
        usable = fits & F.col("_close").isNotNull() & (F.col("_idx") <= F.col("_close"))
    else:
        near = marked.withColumn("_mark", F.when(fits & after, F.struct(F.col("_idx").alias("close"), F.col("_run").alias("run"), spot.alias("last"), (rest if rest is not None else F.lit(None).cast("boolean")).alias("rest"))))
        near = ordered.next_seen(near, keys, order, "_mark", "_later", sliced=True)
        pick = F.coalesce(F.col("_mark"), F.when(F.col("_later.run") == F.col("_run"), F.col("_later")))
        both = near.withColumn("_pick", pick).withColumn("_close", F.col("_pick.close")).withColumn(
            "_end", F.when(F.col("_pick").isNotNull(), F.struct(F.col("_pick.last").alias("last"), F.col("_pick.rest").alias("rest")))
        ).drop("_mark", "_later", "_pick")
        usable = fits & F.col("_close").isNotNull()
    value = _stage_value(spot, F.col("_end.last"), F.col("_close") - F.col("_idx") + 1)
    many = F.when(usable, _joined(value, stages, i, F.col("_end.rest") if rest is not None else None))
    if stage.times == STAR and tail is not None:
        none = F.lit(None).cast(_value_type(rows, spot))
        skip = F.when(F.col(tail).isNotNull(), _joined(none, stages, i, F.col(tail)))
        many = F.coalesce(many, skip) if stage.greedy else F.coalesce(skip, many)
    return both.withColumn(f"_t{i}", many).drop("_after", "_was", "_starts", "_run", "_close", "_end")


def _value_type(rows: DataFrame, spot: Column):
    return rows.select(_stage_value(spot, spot, F.lit(1)).alias("v")).schema["v"].dataType


def _link(rows: DataFrame, keys, order, stages, i: int, tail: str) -> DataFrame:
    """Add ``_after``: the match of stages i.. as reached from this row by the stage's link."""
    stage = stages[i]
    if stage.link == "next":
        if stage.absent is None:
            return ordered.following(rows, keys, order, {"_after": tail}, sliced=True)
        out = ordered.following(rows, keys, order, {"_after": tail, "_no": f"_n{i}"}, sliced=True)
        return out.withColumn("_after", F.when(~F.coalesce("_no", F.lit(False)), F.col("_after"))).drop("_no")
    fits, stop = F.col(f"_c{i}"), F.lit(False)
    if stage.absent and stage.absent[0] == "between":
        stop = F.coalesce(F.col(f"_n{i}"), F.lit(False))
    seen = F.when(fits | stop, F.struct(F.when(~stop, F.col(tail)).alias("t")))
    out = ordered.next_seen(rows.withColumn("_seen_here", seen), keys, order, "_seen_here", "_next", sliced=True)
    out = out.withColumn("_after", F.col("_next.t")).drop("_seen_here", "_next")
    if stage.absent and stage.absent[0] == "next":
        out = ordered.following(written(out, "links"), keys, order, {"_no": f"_n{i}"}, sliced=True)
        out = out.withColumn("_after", F.when(~F.coalesce("_no", F.lit(False)), F.col("_after"))).drop("_no")
    return out


def _find_any(df, keys, order, pattern: Pattern, columns, time, split: int) -> DataFrame:
    """Matches of the stages before the link, joined to those after it inside the time window."""
    if pattern.window is None or time is None:
        raise ValueError("followed_by_any needs within and the time column")
    first, *rest = pattern.stages[split:]
    if first.absent and first.absent[0] == "between":
        raise ValueError("not_followed_by cannot stand before followed_by_any")
    # a negated next row is one that the stages before the link must not be followed by
    head = replace(pattern, stages=pattern.stages[:split], pending=first.absent)
    body = replace(pattern, stages=(replace(first, link="next", absent=None), *rest))
    a = find(df, keys, order, head, columns, time)
    b = find(df, keys, order, body, columns, time)
    last, opening = head.stages[-1].name, first.name
    a = a.withColumn("_at", F.col(f"{last}.last.{time}")).withColumnRenamed("end_idx", "_a_end").withColumnRenamed("start_idx", "_a_start")
    b = b.withColumn("_from", F.col(f"{opening}.first.{time}"))
    paired = joins.interval_join(a, b, keys, "_at", "_from", int(pattern.window), 0)
    found = paired.where("start_idx > _a_end").select(*keys, F.struct(*[F.col(s.name) for s in pattern.stages]).alias("_all"))
    return _finish(found, keys, pattern, "_all", time)


def follow_where(
    df: DataFrame, keys: list[str], order: list[str], time: str, begin: Column, related: Column, columns: list[str],
    seconds: int, every: bool = False,
) -> DataFrame:
    """Two stages whose second condition looks at the first match: rows ``a_*`` and ``b_*``.

    ``related`` is written over ``a_`` and ``b_`` columns. The first fitting later row is taken (or every
    one), within ``seconds``; the pairs are made per (key, time bucket) and reduced to one per start in
    each task.
    """
    kept = list(dict.fromkeys([*order, *columns, time]))
    a = df.where(begin).select(*keys, *[F.col(c).alias(f"a_{c}") for c in kept])
    b = df.select(*keys, *[F.col(c).alias(f"b_{c}") for c in kept])
    later = F.struct(*[F.col(f"b_{c}").alias(c) for c in order]) > F.struct(*[F.col(f"a_{c}").alias(c) for c in order])
    near = joins.interval_join(a, b, keys, f"a_{time}", f"b_{time}", seconds, 0).where(later & related)
    span = F.unix_micros(F.col(f"b_{time}").cast("timestamp")) - F.unix_micros(F.col(f"a_{time}").cast("timestamp"))
    near = near.where(span < seconds * 1_000_000)
    shown = [*keys, *[f"{side}_{c}" for side in "ab" for c in columns]]
    if every:
        return near.select(*shown)
    starts = [f"a_{c}" for c in kept]
    first = near.groupBy(*keys, *starts).agg(
        F.min_by(F.struct(*[f"b_{c}" for c in columns]), F.struct(*[f"b_{c}" for c in order])).alias("_b")
    )
    return first.select(*keys, *[f"a_{c}" for c in columns], "_b.*")


def timed_out(df: DataFrame, keys: list[str], order: list[str], pattern: Pattern, columns: list[str], time: str) -> DataFrame:
    """Start rows whose match did not complete in time, once the stream is past the limit."""
    done = find(df, keys, order, pattern, [*columns, time], time)
    name = pattern.stages[0].name
    begun = df.where(pattern.stages[0].condition)
    latest = df.agg(F.max(F.unix_micros(F.col(time).cast("timestamp")))).scalar()
    over = F.unix_micros(F.col(time).cast("timestamp")) + int(pattern.window * 1_000_000) <= latest
    identity = [c for c in dict.fromkeys([*keys, *order])]
    complete = done.select(*[F.col(c) if c in keys else F.col(f"{name}.first.{c}").alias(c) for c in identity])
    return begun.where(over).join(complete, identity, "left_anti").select(*dict.fromkeys([*keys, *columns]))


def skip(matches: DataFrame, keys: list[str], to: str = "next") -> DataFrame:
    """Choose matches by the after-match rule.

    ``next`` keeps one match per start row (all of them); ``past_last`` resumes after the match's end;
    ``first:name`` and ``last:name`` resume at the first or last row of that stage. From the first match
    of a key, "the next match allowed" is a link; the chosen ones are those reached along the links,
    which doubling the links finds in logarithmically many rounds.
    """
    if to == "next":
        return matches
    if to == "past_last":
        resume = F.col("end_idx") + 1
    else:
        end, _, name = to.partition(":")
        if end not in ("first", "last") or not name:
            raise ValueError("skip to next, past_last, first:name or last:name")
        resume = F.coalesce(F.col(f"{name}.{end}.idx"), F.col("start_idx") + 1)
        resume = F.greatest(resume, F.col("start_idx") + 1)
    table = written(matches, "matches")
    key = F.struct(*keys)
    spots = table.select(key.alias("_key"), "start_idx", resume.alias("_resume"))
    lookups = spots.select("_key", F.col("start_idx").alias("id"), (-F.col("_resume")).alias("_at"))
    starts = spots.select("_key", (-F.col("start_idx")).alias("_at"), F.col("start_idx").alias("jump"))
    linked = joins.temporal_join(lookups, starts.withColumn("_tie", F.lit("")), "_key", "_at", "_at", "_tie", ["jump"], "left")
    first = spots.groupBy("_key").agg(F.min("start_idx").alias("_first"))
    state = written(linked.join(first, "_key").select("_key", "id", "jump", (F.col("id") == F.col("_first")).alias("kept")), "links")
    while True:
        targets = state.where("kept AND jump IS NOT NULL").select("_key", F.col("jump").alias("id")).distinct()
        hops = state.select("_key", F.col("id").alias("jump"), F.col("jump").alias("_further"))
        grown = state.join(targets.withColumn("_hit", F.lit(True)), ["_key", "id"], "left").join(hops, ["_key", "jump"], "left")
        kept = F.col("kept") | F.coalesce("_hit", F.lit(False))
        doubled = grown.select("_key", "id", F.col("_further").alias("jump"), kept.alias("kept"))
        state, seen = written_and_measured(doubled, "links", open=F.count("jump"))
        if seen["open"] == 0:
            break
    chosen = state.where("kept").select("_key.*", F.col("id").alias("start_idx"))
    return table.join(chosen, [*keys, "start_idx"], "left_semi")


def match_recognize(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    pattern: list[tuple[str, str]],
    define: dict[str, Column],
    measures: dict[str, Column],
    columns: list[str],
    after_match: str = "next",
    within: float | None = None,
    time: str | None = None,
) -> DataFrame:
    """MATCH_RECOGNIZE with one row per match; the default resumes at the next row.

    ``pattern`` lists (variable, quantifier) with '', '?', '+', '*' or the reluctant '+?', '*?'. A
    variable without a definition fits every row. Measures use ``var.first.col``, ``var.last.col`` and
    ``var.n``.
    """
    built = Pattern()
    for name, times in pattern:
        built = built.next(name, define.get(name, F.lit(True)), times.rstrip("?") if len(times) == 2 else times, len(times) < 2)
    if within is not None:
        built = built.within(within)
    matches = skip(find(df, partition, order, built, columns, time), partition, after_match)
    return matches.select(*partition, *[value.alias(name) for name, value in measures.items()])
