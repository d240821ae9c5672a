"""Per-key ordered operators that do not need a whole key in one task.

``slice_rows`` range-partitions on (keys, order) and writes the result, so a hot key is cut into
many slices of similar size. Each operator works inside (slice, key) and then adds what the earlier
slices of the same key contribute. At most one key can continue into a slice, so that carry has
fewer rows than there are slices, whatever the data looks like; this is why it may be broadcast.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.partials import Partials
from millrace.scratch import written

SLICE = "_slice"


def slice_rows(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Cut the rows into ordered slices. ``order`` should end in a unique column."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys, *order)
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _inside(keys, order) -> W:
    return W.partitionBy(SLICE, *keys).orderBy(*order)


def _earlier_slices(keys) -> W:
    return W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)


def _attach(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join the carry (one row per slice at most) as struct ``_carry``."""
    renamed = carry.select(
        F.col(SLICE).alias("_c_slice"), *[F.col(k).alias(f"_c_{k}") for k in keys], "_carry"
    )
    match = [F.col(SLICE) == F.col("_c_slice")]
    match += [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    joined = rows.join(F.broadcast(renamed), functools.reduce(lambda a, b: a & b, match), "left")
    return joined.drop("_c_slice", *[f"_c_{k}" for k in keys])


def _carry_from(summary: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    earlier = _earlier_slices(keys)
    picked = summary.select(
        SLICE, *keys, F.struct(*columns).alias("_carry"), F.count(F.lit(1)).over(earlier).alias("_before")
    )
    return picked.where("_before > 0").drop("_before")


def time_bucket(micros: Column, width: int) -> Column:
    """Index of the ``width`` microseconds wide bucket, in whole-number arithmetic."""
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    spec: dict[str, tuple[str, str]],
    peers: bool = False,
    sliced: bool = False,
    slices: int | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Aggregates from the first row of the key up to this one (ROWS, or RANGE with ``peers``).

    ``exclusive`` leaves the row itself out.

    With ``peers`` the order columns decide who is equal; equal rows share one value. They stay in
    one slice, as range partitioning never splits equal sort keys.
    """
    parts = Partials(spec)
    rows = df if sliced else slice_rows(df, keys, order, slices)
    frame = _inside(keys, order)
    last = -1 if exclusive else 0
    frame = frame.rangeBetween(W.unboundedPreceding, 0) if peers else frame.rowsBetween(W.unboundedPreceding, last)
    summary = rows.groupBy(SLICE, *keys).agg(*parts.first())
    earlier = _earlier_slices(keys)
    carry = _carry_from(summary, keys, parts.merge(lambda c: c.over(earlier)))
    here = rows.select("*", F.struct(*parts.first(lambda c: c.over(frame))).alias("_here"))
    both = _attach(here, carry, keys)
    kept = list(rows.columns)
    out = both.select(*kept, *parts.join("_here", "_carry")).select(*kept, *parts.finish())
    return out if sliced else out.drop(SLICE)


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str = "idx", sliced: bool = False, slices: int | None = None
) -> DataFrame:
    """0-based position of each row inside its key."""
    out = running(df, keys, order, {name: ("count", "*")}, sliced=sliced, slices=slices)
    return out.withColumn(name, F.col(name) - 1)


def previous(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], sliced: bool = False, slices: int | None = None
) -> DataFrame:
    """``columns`` maps new name -> source column of the row just before, in the same key."""
    rows = df if sliced else slice_rows(df, keys, order, slices)
    before = F.struct(*[F.col(src).alias(dst) for dst, src in columns.items()])
    summary = rows.groupBy(SLICE, *keys).agg(F.max_by(before, F.struct(*order)).alias("_last"))
    latest = F.last("_last").over(_earlier_slices(keys))
    carry = _carry_from(summary, keys, [latest.alias("last")])
    here = rows.withColumn("_lag", F.lag(before).over(_inside(keys, order)))
    both = _attach(here, carry, keys)
    value = F.coalesce(F.col("_lag"), F.col("_carry.last"))
    out = both.select(*rows.columns, *[value[dst].alias(dst) for dst in columns])
    return out if sliced else out.drop(SLICE)


def following(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], sliced: bool = False, slices: int | None = None
) -> DataFrame:
    """``columns`` maps new name -> source column of the row just after, in the same key."""
    rows = df if sliced else slice_rows(df, keys, order, slices)
    after = F.struct(*[F.col(src).alias(dst) for dst, src in columns.items()])
    summary = rows.groupBy(SLICE, *keys).agg(F.min_by(after, F.struct(*order)).alias("_first"))
    nearest = F.lead("_first").over(W.partitionBy(*keys).orderBy(SLICE))
    later = summary.withColumn("_next", nearest).where(F.col("_next").isNotNull())
    carry = later.select(SLICE, *keys, F.struct(F.col("_next").alias("first")).alias("_carry"))
    here = rows.withColumn("_lead", F.lead(after).over(_inside(keys, order)))
    both = _attach(here, carry, keys)
    value = F.coalesce(F.col("_lead"), F.col("_carry.first"))
    out = both.select(*rows.columns, *[value[dst].alias(dst) for dst in columns])
    return out if sliced else out.drop(SLICE)


def latest_seen(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str, sliced: bool = False, slices: int | None = None
) -> DataFrame:
    """The last non-null ``column`` at or before each row of the key."""
    rows = df if sliced else slice_rows(df, keys, order, slices)
    filled = F.when(F.col(column).isNotNull(), F.struct(*order))
    summary = rows.groupBy(SLICE, *keys).agg(F.max_by(column, filled).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(_earlier_slices(keys))
    carry = _carry_from(summary, keys, [carried.alias("last")])
    frame = _inside(keys, order).rowsBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("_seen", F.last(column, ignorenulls=True).over(frame))
    both = _attach(here, carry, keys)
    out = both.select(*rows.columns, F.coalesce(F.col("_seen"), F.col("_carry.last")).alias(name))
    return out if sliced else out.drop(SLICE)


def over_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    preceding: int,
    spec: dict[str, tuple[str, str]],
    block: int = 65536,
    slices: int | None = None,
) -> DataFrame:
    """Aggregates over the row and the ``preceding`` rows before it.

    A key is cut into blocks of consecutive rows; the last ``preceding`` rows of a block are also
    sent to the next one as context.
    """
    block = max(block, preceding)
    parts = Partials(spec)
    rows = numbered(df, keys, order, "_idx", slices=slices)
    own = F.expr(f"_idx div {block}")
    reach = F.when(F.col("_idx") % block >= block - preceding, F.array(own, own + 1)).otherwise(F.array(own))
    placed = rows.select("*", own.alias("_own"), F.explode(reach).alias("_block"))
    frame = W.partitionBy(*keys, "_block").orderBy("_idx").rowsBetween(-preceding, 0)
    kept = df.columns
    framed = placed.select(*kept, "_own", "_block", *parts.first(lambda c: c.over(frame)))
    return framed.where("_own = _block").select(*kept, *parts.finish())


def over_time(
    df: DataFrame, keys: list[str], time: str, seconds: int, spec: dict[str, tuple[str, str]], bucket: int | None = None
) -> DataFrame:
    """Aggregates over the rows of the key from ``seconds`` before this row up to it (RANGE).

    Time is cut into buckets as wide as the frame, so that a frame is the end of one bucket and the beginning of
    the next. Both are running aggregates, one from each end of a bucket, and are put together; the work grows
    with the rows, not with the rows of a frame. ``bucket`` is no longer needed. Rows without a time are dropped.
    """
    parts = Partials(spec)
    kept = df.columns
    rows = df.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).where("_at IS NOT NULL")
    if seconds <= 0:
        peers = rows.select("*", *parts.first(lambda c: c.over(W.partitionBy(*keys, "_at"))))
        return peers.select(*kept, *parts.finish())
    width = seconds * 1_000_000
    inside = W.partitionBy(*keys, "_own")
    upwards = inside.orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    downwards = inside.orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_own", time_bucket(F.col("_at"), width))
    rows = rows.withColumn("_here", F.struct(*parts.first(lambda c: c.over(upwards))))
    rows = rows.withColumn("_rest", F.struct(*parts.first(lambda c: c.over(downwards))))
    # each row stands in its bucket with what follows it there, and asks the bucket before from its own time less the frame on
    asks = F.struct(F.lit(True).alias("asks"), (F.col("_own") - 1).alias("in"), (F.col("_at") - width).alias("from"))
    stands = F.struct(F.lit(False).alias("asks"), F.col("_own").alias("in"), F.col("_at").alias("from"))
    both = rows.withColumn("_p", F.explode(F.array(stands, asks)))
    seen = W.partitionBy(*keys, F.col("_p.in")).orderBy(F.desc("_p.from"), "_p.asks").rowsBetween(W.unboundedPreceding, 0)
    carried = F.last(F.when(~F.col("_p.asks"), F.col("_rest")), ignorenulls=True).over(seen)
    asked = both.withColumn("_carry", carried).where("_p.asks")
    return asked.select(*kept, *parts.join("_here", "_carry")).select(*kept, *parts.finish())


def next_seen(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str, sliced: bool = False, slices: int | None = None
) -> DataFrame:
    """The first non-null ``column`` strictly after each row of the key."""
    rows = df if sliced else slice_rows(df, keys, order, slices)
    filled = F.when(F.col(column).isNotNull(), F.struct(*order))
    summary = rows.groupBy(SLICE, *keys).agg(F.min_by(column, filled).alias("_first"))
    later = W.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    nearest = F.last("_first", ignorenulls=True).over(later)
    picked = summary.withColumn("_next", nearest).where(F.col("_next").isNotNull())
    carry = picked.select(SLICE, *keys, F.struct(F.col("_next").alias("first")).alias("_carry"))
    frame = W.partitionBy(SLICE, *keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    here = rows.withColumn("_seen", F.last(column, ignorenulls=True).over(frame))
    both = _attach(here, carry, keys)
    out = both.select(*rows.columns, F.coalesce(F.col("_seen"), F.col("_carry.first")).alias(name))
    return out if sliced else out.drop(SLICE)
