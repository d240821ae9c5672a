"""Session windows whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.partials import Partials
from millrace.scratch import written


def session_ids(
    df: DataFrame, keys: list[str], time: str, order: list[str], gap_seconds: int | Column, slices: int | None = None
) -> DataFrame:
    """The rows with ``_end`` (microseconds) and ``_session``, the number of their session inside the key.

    Row ``r`` covers ``[time, time + gap]``; rows that touch belong together. The end reached so far is
    a running maximum, a new session starts where time exceeds it, and the session number is a running
    sum of those starts. Both run on slices, so no key is held in one task.
    """
    gap = F.lit(gap_seconds) if isinstance(gap_seconds, int) else gap_seconds
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    checked = F.when(gap > 0, gap).otherwise(F.raise_error(F.lit("session gap must be positive")).cast("bigint"))
    timed = df.withColumn("_end", micros + checked * F.lit(1_000_000))
    rows = ordered.slice_rows(timed, keys, order, slices)
    flagged = ordered.running(rows, keys, order, {"_before": ("max", "_end")}, sliced=True, exclusive=True)
    starts = F.when(F.col("_before").isNull() | (micros > F.col("_before")), 1).otherwise(0)
    flagged = flagged.withColumn("_starts", starts)
    return ordered.running(flagged, keys, order, {"_session": ("sum", "_starts")}, sliced=True)


def sessions(
    df: DataFrame,
    keys: list[str],
    time: str,
    order: list[str],
    gap_seconds: int | Column,
    spec: dict[str, tuple[str, str]],
    slices: int | None = None,
) -> DataFrame:
    """Merge rows into sessions; ``gap_seconds`` may be a column (dynamic gap, must be > 0)."""
    counted = session_ids(df, keys, time, order, gap_seconds, slices)
    parts = Partials(spec)
    own_type = df.schema[time].dataType.simpleString()
    merged = counted.groupBy(*keys, "_session").agg(
        F.min(time).alias("window_start"), F.max("_end").alias("_last"), *parts.first()
    )
    closes = F.timestamp_micros("_last").cast(own_type).alias("window_end")
    return merged.select(*keys, "window_start", closes, *parts.finish())


def session_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, gap_seconds: int, slices: int | None = None
) -> DataFrame:
    """Join rows of one key that fall into one session of both inputs: the rows of both sides make the sessions.

    Columns other than the keys have different names on the two sides. Rows with null keys join nothing.
    """
    a = left.select(*keys, F.col(left_time).alias("_at"), F.lit(0).alias("_side"), F.struct("*").alias("_left"))
    b = right.select(*keys, F.col(right_time).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_id", F.xxhash64("_left", "_right"))
    known = written(session_ids(both, keys, "_at", ["_at", "_side", "_id"], gap_seconds, slices), "session-join")
    lefts = known.where("_side = 0").select(*keys, "_session", "_left")
    rights = known.where("_side = 1").select(*keys, "_session", "_right")
    joined = lefts.join(rights, [*keys, "_session"])
    rest = [F.col(f"_left.{c}") for c in left.columns if c not in keys] + [F.col(f"_right.{c}") for c in right.columns if c not in keys]
    return joined.select(*keys, *rest)
