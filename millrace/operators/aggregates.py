"""Aggregates whose rules differ from Spark's, column summaries and reducers written in Python."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Occurrences of one element of a multiset that one task writes out at a time.
REPEATS = 1 << 16

#: Rows of a key from which on a user-defined aggregate accumulates it in parts.
HOT = 100_000


def avg_keep_type(column: str, kind: str) -> Column:
    """AVG that keeps a whole-number type: the quotient is truncated. Sums of bigints do not overflow."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        wide = "decimal(38,0)" if kind == "bigint" else "bigint"
        sums, n = F.sum(F.col(column).cast(wide)), F.count(column)
        return F.when(n > 0, F.call_function("div", sums, n.cast(wide))).cast(kind)
    return F.avg(column)


def sum0(column: str | Column) -> Column:
    """SUM that is 0 when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def grouping_bits(columns: list[str]) -> Column:
    """GROUPING_ID with bit 1 for a column that IS grouped; the first column is the highest bit."""
    width = len(columns)
    return sum(((1 - F.grouping(c).cast("bigint")) * (1 << (width - 1 - i)) for i, c in enumerate(columns)), F.lit(0))


def group_id(columns: list[str]) -> Column:
    """GROUP_ID: sum of ``1 << position`` over the grouped columns."""
    return sum(((1 - F.grouping(c).cast("bigint")) * (1 << i) for i, c in enumerate(columns)), F.lit(0))


def multiset(df: DataFrame, keys: list[str], column: str, name: str = "items") -> DataFrame:
    """COLLECT: a map element -> count per key. Rows are counted first; only distinct elements meet."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col(column).alias("key"), F.col("_n").alias("value"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def unnest_multiset(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per element occurrence of a multiset; null or empty gives no rows."""
    rest = [c for c in df.columns if c != column]
    entries = df.select(*rest, F.explode(column).alias(name, "_n"))
    # a large count is cut into stretches that are dealt out before they are repeated
    stretch = F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("_n") - 1, F.lit(REPEATS))))
    cut = entries.select(*rest, name, "_n", stretch.alias("_k")).repartition(*rest, name, "_k")
    many = F.least(F.col("_n") - F.col("_k") * REPEATS, F.lit(REPEATS)).cast("int")
    return cut.select(*rest, name, F.explode(F.array_repeat(F.lit(1), many)).alias("_i")).drop("_i")


def checksum(df: DataFrame) -> DataFrame:
    """Order-free checksum and row count: the sum of a 32-bit digest of every row's text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    total = sum0(digest.cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), total.cast("decimal(38,0)").alias("checksum"))


def summarize(df: DataFrame) -> DataFrame:
    """One row per column with statistics by type, computed in a single pass."""
    names = (
        "total nulls nans infinites min max sum mean variance stddev empty min_length max_length mean_length "
        "trues falses"
    ).split()
    pieces, rows = [], []
    for i, field in enumerate(df.schema.fields):
        c, kind = F.col(field.name), field.dataType
        stats: dict[str, Column] = {"total": F.count(F.lit(1)), "nulls": F.count_if(c.isNull())}
        if isinstance(kind, T.NumericType):
            number = c.cast("double")
            odd = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
            usable = F.when(~odd, number)
            stats |= {
                "nans": F.count_if(F.isnan(number)),
                "infinites": F.count_if(F.abs(number) == F.lit(float("inf"))),
                "min": F.min(usable),
                "max": F.max(usable),
                "sum": F.sum(usable),
                "mean": F.avg(usable),
                "variance": F.var_samp(usable),
                "stddev": F.stddev_samp(usable),
            }
        elif isinstance(kind, T.StringType):
            length = F.length(c)
            stats |= {
                "empty": F.count_if(length == 0),
                "min_length": F.min(length),
                "max_length": F.max(length),
                "mean_length": F.avg(length),
            }
        elif isinstance(kind, T.BooleanType):
            stats |= {"trues": F.count_if(c), "falses": F.count_if(~c)}
        pieces += [value.alias(f"c{i}_{name}") for name, value in stats.items()]
        whole = {"total", "nulls", "nans", "infinites", "empty", "min_length", "max_length", "trues", "falses"}
        cells = [F.lit(field.name).alias("column")]
        for name in names:
            value = F.col(f"c{i}_{name}") if name in stats else F.lit(None)
            cells.append(value.cast("bigint" if name in whole else "double").alias(name))
        rows.append(F.struct(*cells))
    return df.agg(*pieces).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def combine_groups(
    df: DataFrame, keys: list[str], combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keep: int = 50_000
) -> DataFrame:
    """Partial reduction inside each task (no shuffle): at least one row per key and task.

    ``combine`` gets the rows of one key and returns one row of the same columns.
    """

    def shrink(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [combine(group) for _, group in rows.groupby(keys, sort=False, dropna=False)]
        return pd.concat(parts, ignore_index=True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if batch.empty:
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = shrink(rows)
            if len(held) > keep:
                yield held
                held = None
        if held is not None:
            yield held

    return df.mapInPandas(task, schema)


def reduce_groups(
    df: DataFrame, keys: list[str], combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Associative reduce in Python: reduced in the tasks, then again over the few partial rows per key."""
    return combine_groups(df, keys, combine, schema).groupBy(*keys).applyInPandas(combine, schema)


class UserAggregate:
    """A user-defined aggregate: ``accumulate`` rows into an accumulator row, ``merge`` two rows, ``value``.

    Subclasses name the accumulator columns in ``state`` (DDL) and the result in ``result`` (DDL type).
    """

    state: str
    result: str

    def accumulate(self, rows: pd.DataFrame) -> dict:
        raise NotImplementedError

    def merge(self, rows: pd.DataFrame) -> dict:
        raise NotImplementedError

    def value(self, rows: pd.DataFrame) -> pd.Series:
        raise NotImplementedError


def aggregate_user(df: DataFrame, keys: list[str], aggregate: UserAggregate, name: str) -> DataFrame:
    """Run a :class:`UserAggregate` per key: an accumulator per key or part of a hot key, merged after a second shuffle.

    Rows meet by key before Python sees them, so that it is called once for a key and not once for a key
    and batch. Keys with more than ``HOT`` rows are cut into parts; there are fewer of them than rows / ``HOT``.
    """
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema, columns = f"{key_schema}, {aggregate.state}", df.columns

    def row_of(group: pd.DataFrame, values: dict) -> pd.DataFrame:
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, **values}])

    def first(group: pd.DataFrame) -> pd.DataFrame:
        return row_of(group, aggregate.accumulate(group[columns]))

    def final(group: pd.DataFrame) -> pd.DataFrame:
        merged = row_of(group, aggregate.merge(group))
        return merged[keys].assign(**{name: aggregate.value(merged)})

    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT)
    hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_rows") / HOT).alias("_parts"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))
    dealt = df.join(F.broadcast(hot), same, "left").select(*df.columns, part.alias("_part"))
    partial = dealt.groupBy(*keys, "_part").applyInPandas(first, schema)
    return partial.groupBy(*keys).applyInPandas(final, f"{key_schema}, `{name}` {aggregate.result}")
