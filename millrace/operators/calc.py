"""Projection, sorting, limits, positions and samples."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordered
from millrace.scratch import written


class RuleError(ValueError):
    """A query breaks a rule that the operator enforces."""


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    """``select`` that refuses duplicate output names."""
    out = df.select(*columns)
    twice = [name for name, n in Counter(c.lower() for c in out.columns).items() if n > 1]
    if twice:
        raise RuleError(f"duplicate output columns: {twice}")
    return out


def rename(df: DataFrame, *names: str) -> DataFrame:
    """Rename all columns by position; ``*`` and duplicates are refused."""
    if "*" in names:
        raise RuleError("* is not a column name")
    if len(set(names)) != len(names):
        raise RuleError("duplicate column names")
    if len(names) != len(df.columns):
        raise RuleError(f"{len(df.columns)} columns need {len(df.columns)} names")
    return df.toDF(*names)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields, named ``column_field``."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StructType):
        return df
    out = []
    for name in df.columns:
        if name == column:
            out += [F.col(f"{column}.{f.name}").alias(f"{column}_{f.name}") for f in kind.fields]
        else:
            out.append(F.col(name))
    return project(df, *out)


def limit_sorted(df: DataFrame, order: list[Column], fetch: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with OFFSET / FETCH; a limit without an order is refused."""
    if not order:
        raise RuleError("OFFSET and FETCH need an ORDER BY")
    if offset < 0 or (fetch is not None and fetch < 0):
        raise RuleError("OFFSET and FETCH must not be negative")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if fetch is None else out.limit(fetch)


def first_n(df: DataFrame, n: int, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Any ``n`` rows, or the first ``n`` per key in ``order``.

    Spark limits each key to ``n`` rows before the shuffle (window group limit), so hot keys stay small.
    """
    if not keys:
        return limit_sorted(df, order, n) if order else df.limit(n)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or [F.lit(0)])))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def zip_with_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Consecutive 0-based index over all rows, without a single-task sort."""
    return ordered.numbered(df, [], order, name)


def zip_with_unique_id(df: DataFrame, name: str = "uid") -> DataFrame:
    """Unique but not consecutive ids, no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def count_per_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def _weight(identity: list[str], seed: int, *more: Column) -> Column:
    """Repeatable pseudo-random order that does not depend on partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in identity], *more)


def sample_rows(df: DataFrame, size: int, identity: list[str], seed: int = 0) -> DataFrame:
    """Exactly ``size`` distinct rows (or all, if fewer): the smallest hash weights win."""
    return df.withColumn("_w", _weight(identity, seed)).orderBy("_w", *identity).limit(size).drop("_w")


def sample_rows_with_replacement(df: DataFrame, size: int, order: list[str], seed: int = 0) -> DataFrame:
    """Exactly ``size`` draws: every draw picks a hashed position, joined to the numbered rows."""
    indexed = written(zip_with_index(df, order, "_idx"), "positions")
    rows = indexed.count()
    if rows == 0:
        return indexed.select(F.lit(0).cast("bigint").alias("draw"), *df.columns)
    picks = df.sparkSession.range(size).select(
        F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(rows)).alias("_idx")
    )
    return indexed.join(picks, "_idx").select("draw", *df.columns)


def sample_fraction(df: DataFrame, fraction: float, replace: bool = False, seed: int = 0) -> DataFrame:
    """Bernoulli sample, or Poisson with ``replace``."""
    return df.sample(replace, fraction, seed)


def split_exactly(df: DataFrame, fractions: list[float], identity: list[str], seed: int = 0) -> list[DataFrame]:
    """Disjoint parts with exact sizes ``round(cumulative fraction * rows)``."""
    total = sum(fractions)
    shuffled = written(zip_with_index(df.withColumn("_w", _weight(identity, seed)), ["_w", *identity], "_idx"), "split")
    rows = shuffled.count()
    parts, begin, share = [], 0, 0.0
    for fraction in fractions:
        share += fraction / total
        end = round(share * rows)
        parts.append(shuffled.where((F.col("_idx") >= begin) & (F.col("_idx") < end)).drop("_idx", "_w"))
        begin = end
    return parts


def custom_partition(df: DataFrame, number: Column, partitions: int) -> DataFrame:
    """Put each row into the very partition named by ``number`` (any whole number, modulo ``partitions``)."""
    return df.repartitionById(partitions, F.pmod(number, F.lit(partitions)).cast("int"))
