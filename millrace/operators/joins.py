"""Joins beyond a plain ``DataFrame.join``: skewed, time-bounded, versioned and windowed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.partials import Partials


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``max_rows`` rows; else leave it be."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of the rows: never more than ``1 / share`` of them."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n").alias("_all"))
    return counted.where(F.col("_n") >= share * total.scalar()).select(*keys)


def skew_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = 0.02, salts: int = 32,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on same-named keys; hot left keys are salted, the matching right rows repeated.

    Only right rows of hot keys are repeated, so the extra volume is ``salts`` copies of few rows.
    ``profile`` is the frame to count keys on, when ``left`` is dear to compute twice (say, a join
    that keeps the shares of an input).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("swap the sides: the right side is the one that may be repeated")
    hot = F.broadcast(hot_keys(left if profile is None else profile, keys, share).withColumn("_hot", F.lit(True)))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    numbered = left.withColumn("_turn", turn)
    salted_left = numbered.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.col("_turn")).otherwise(0)
    ).drop("_hot", "_turn")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def flat_join(left: DataFrame, right: DataFrame, keys: list[str], results: Column, schema_name: str = "result", how: str = "inner") -> DataFrame:
    """Join with a function of the pair: ``results`` is an array over the columns of both sides, one row out for each element.

    An empty or null array drops the pair (J6).
    """
    return left.join(right, keys, how).select(*keys, F.explode(results).alias(schema_name))


def scalar_filter(df: DataFrame, aggregate: DataFrame, condition) -> DataFrame:
    """Join with a one-row aggregate (J4): ``condition(scalar)`` gives the predicate."""
    return df.where(condition(aggregate.scalar()))


def cogroup(
    left: DataFrame, right: DataFrame, keys: list[str], left_spec: dict, right_spec: dict
) -> DataFrame:
    """Both groups of a key side by side, each reduced on its own side before they meet.

    Keys present on one side only are kept; the other side's columns are null.
    """
    a, b = Partials(left_spec), Partials(right_spec)
    lefts = left.groupBy(*keys).agg(*a.first()).select(*keys, *a.finish())
    rights = right.groupBy(*keys).agg(*b.first()).select(*keys, *b.finish())
    return lefts.join(rights, keys, "full")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    before: int,
    after: int,
    how: str = "inner",
) -> DataFrame:
    """Pairs with ``left_time`` between ``right_time - before`` and ``right_time + after`` (seconds).

    Time is cut into buckets as wide as the interval, so a right row visits two buckets at most and the
    join hashes on (keys, bucket) instead of on the key alone.
    """
    width = max(before + after, 1) * 1_000_000
    l_at = F.unix_micros(F.col(left_time).cast("timestamp"))
    r_at = F.unix_micros(F.col(right_time).cast("timestamp"))
    lo, hi = r_at - before * 1_000_000, r_at + after * 1_000_000
    lefts = left.withColumn("_l_at", l_at).withColumn("_bucket", ordered.time_bucket(F.col("_l_at"), width))
    reach = F.sequence(ordered.time_bucket(lo, width), ordered.time_bucket(hi, width))
    rights = right.select(
        *[F.col(c) if c not in keys else F.col(c).alias(f"_r_{c}") for c in right.columns],
        r_at.alias("_r_at"),
        F.explode(reach).alias("_r_bucket"),
    )
    match = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    match += [
        F.col("_bucket") == F.col("_r_bucket"),
        F.col("_l_at") >= F.col("_r_at") - before * 1_000_000,
        F.col("_l_at") <= F.col("_r_at") + after * 1_000_000,
    ]
    drop = ["_l_at", "_bucket", "_r_at", "_r_bucket", *[f"_r_{k}" for k in keys]]
    if how in ("inner", "left", "left_semi", "left_anti"):
        return lefts.join(rights, all_of(match), how).drop(*drop)
    if how == "right":
        flipped = interval_join(right, left, keys, right_time, left_time, after, before, "left")
        return flipped.select(*left.columns, *[c for c in right.columns if c not in keys])
    if how == "full":
        matched = interval_join(left, right, keys, left_time, right_time, before, after, "left")
        alone = interval_join(right, left, keys, right_time, left_time, after, before, "left_anti")
        return matched.unionByName(alone, allowMissingColumns=True)
    raise ValueError(f"unknown join type {how}")


def temporal_join(
    left: DataFrame,
    versions: DataFrame,
    key: str,
    left_time: str,
    version_time: str,
    version_tie: str,
    columns: list[str],
    how: str = "inner",
    slices: int | None = None,
) -> DataFrame:
    """Each left row with the version of its key that was valid at ``left_time``.

    Both sides go into one timeline per key and the latest version is carried forward, so a key with a
    long history is never multiplied out and never held whole.
    """
    payload = F.struct(*columns)
    history = versions.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(version_time).alias("_at"),
        F.lit(0).alias("_side"),
        F.col(version_tie).alias("_tie"),
        payload.alias("_version"),
        F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    probes = left.select(
        F.col(key).alias("_key"),
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(versions.select(version_tie).schema[0].dataType).alias("_tie"),
        F.lit(None).cast(versions.select(payload).schema[0].dataType).alias("_version"),
        F.struct("*").alias("_row"),
    )
    order = ["_at", "_side", "_tie"]
    seen = ordered.latest_seen(history.unionByName(probes), ["_key"], order, "_version", "_valid", slices=slices)
    out = seen.where("_side = 1")
    if how == "inner":
        out = out.where(F.col("_valid").isNotNull())
    elif how != "left":
        raise ValueError("a temporal join is inner or left")
    return out.select("_row.*", *[F.col(f"_valid.{c}").alias(c) for c in columns])


def window_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: Column | str,
    slide: str | None = None, how: str = "inner",
) -> DataFrame:
    """Join rows of the same key that fall into the same tumbling or sliding window."""
    a = left.withColumn("_w", F.window(left_time, window, slide or window))
    b = right.withColumn("_w", F.window(right_time, window, slide or window))
    joined = a.join(b, [*keys, "_w"], how)
    rest = [c for c in joined.columns if c != "_w" and c not in keys]
    return joined.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rest)
