"""Group windows over tables: time, count, evicted and early-fired windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.partials import Partials


def _own_type(df: DataFrame, time: str) -> str:
    return df.schema[time].dataType.simpleString()


def window_rowtime(window_end: Column) -> Column:
    """The rowtime of a window: its end less one millisecond."""
    return window_end - F.expr("INTERVAL '0.001' SECOND")


def tumble(df: DataFrame, keys: list[str], time: str, size: str, spec: dict, offset: str | None = None) -> DataFrame:
    """``[start, start + size)`` windows."""
    parts = Partials(spec)
    window = F.window(time, size, startTime=offset) if offset else F.window(time, size)
    grouped = df.groupBy(*keys, window.alias("_w")).agg(*parts.first())
    return grouped.select(
        *keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *parts.finish()
    )


def hop(df: DataFrame, keys: list[str], time: str, slide_seconds: int, size_seconds: int, spec: dict) -> DataFrame:
    """Sliding windows: rows are reduced to panes of one slide first, then each pane visits its windows.

    The copy factor (size / slide) thus applies to panes, not to rows. When the size is not a multiple
    of the slide, panes are as wide as their common divisor.
    """
    import math

    parts = Partials(spec)
    pane = math.gcd(slide_seconds, size_seconds) * 1_000_000
    slide, size = slide_seconds * 1_000_000, size_seconds * 1_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    panes = df.groupBy(*keys, (micros - F.pmod(micros, F.lit(pane))).alias("_pane")).agg(*parts.first())
    newest = F.col("_pane") - F.pmod(F.col("_pane"), F.lit(slide))
    oldest = newest - ((size - 1) // slide) * slide
    starts = F.explode(F.sequence(oldest, newest, F.lit(slide)))
    visits = panes.withColumn("_start", starts).where(F.col("_pane") < F.col("_start") + size)
    merged = visits.groupBy(*keys, "_start").agg(*parts.merge())
    kind = _own_type(df, time)
    return merged.select(
        *keys,
        F.timestamp_micros("_start").cast(kind).alias("window_start"),
        F.timestamp_micros(F.col("_start") + size).cast(kind).alias("window_end"),
        *parts.finish(),
    )


def tumble_rows(df: DataFrame, keys: list[str], order: list[str], size: int, spec: dict) -> DataFrame:
    """Windows of ``size`` consecutive rows per key; a window that never fills gives no result."""
    parts = Partials({**spec, "_rows": ("count", "*")})
    rows = ordered.numbered(df, keys, order, "_idx").withColumn("window", F.expr(f"_idx div {size}"))
    grouped = rows.groupBy(*keys, "window").agg(*parts.first()).select(*keys, "window", *parts.finish())
    return grouped.where(F.col("_rows") == size).drop("_rows")


def slide_rows(df: DataFrame, keys: list[str], order: list[str], size: int, slide: int, spec: dict) -> DataFrame:
    """After every ``slide`` rows of a key, a result over its last ``size`` rows (fewer at the start).

    Rows are reduced to panes as wide as the common divisor of size and slide first, then each pane visits its
    windows; a window fires when its last pane is full.
    """
    import math

    parts = Partials({**spec, "_held": ("count", "*")})
    pane = math.gcd(size, slide)
    rows = ordered.numbered(df, keys, order, "_idx")
    panes = rows.groupBy(*keys, F.expr(f"_idx div {pane}").alias("_pane")).agg(*parts.first())
    first, last = F.expr(f"_pane * {pane} div {slide}"), F.expr(f"(_pane * {pane} + {size}) div {slide} - 1")
    visits = panes.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    ending = F.col("_pane") == F.expr(f"(window + 1) * {slide} div {pane} - 1")
    full = F.max(F.when(ending, F.col("__held_count"))).alias("_full")
    merged = visits.groupBy(*keys, "window").agg(*parts.merge(), full).where(F.col("_full") == pane)
    return merged.select(*keys, "window", *parts.finish()).select(*keys, "window", *spec)


def keep_last_rows(df: DataFrame, groups: list[str], order: list[Column], count: int) -> DataFrame:
    """Count evictor: the last ``count`` rows of each window stay. ``order`` is latest first."""
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")


def keep_recent(df: DataFrame, groups: list[str], time: str, seconds: float) -> DataFrame:
    """Time evictor: rows older than ``seconds`` before the newest row of the window leave."""
    newest = df.groupBy(*groups).agg(F.max(time).alias("_newest"))
    span = F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return df.join(newest, groups).where(span <= int(seconds * 1_000_000)).drop("_newest")


def keep_near_last(df: DataFrame, groups: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """Delta evictor: rows whose distance to the last row of the window reaches ``threshold`` leave."""
    last = df.groupBy(*groups).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    near = F.abs(F.col("_last") - F.col(value)) < threshold
    return df.join(last, groups).where(near).drop("_last")


def early_results(
    df: DataFrame, keys: list[str], time: str, size_seconds: int, every_seconds: int, spec: dict
) -> DataFrame:
    """Continuous trigger: the contents so far of each window, every ``every_seconds`` of event time."""
    parts = Partials(spec)
    size, every = size_seconds * 1_000_000, every_seconds * 1_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    start = micros - F.pmod(micros, F.lit(size))
    pane = micros - F.pmod(micros, F.lit(every))
    panes = df.groupBy(*keys, start.alias("_start"), pane.alias("_pane")).agg(*parts.first())
    fires = F.explode(F.sequence(F.col("_pane") + every, F.col("_start") + size, F.lit(every)))
    fired = panes.withColumn("_fire", fires).groupBy(*keys, "_start", "_fire").agg(*parts.merge())
    kind = _own_type(df, time)
    return fired.select(
        *keys,
        F.timestamp_micros("_start").cast(kind).alias("window_start"),
        F.timestamp_micros("_fire").cast(kind).alias("fired_at"),
        *parts.finish(),
    )
