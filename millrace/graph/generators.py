"""Generated graphs: ranges and arithmetic, nothing on the driver."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _edges(vertices: DataFrame, targets: Column) -> DataFrame:
    return vertices.select(F.col("id").alias("src"), F.explode(targets).alias("dst"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def empty(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    vertices = spark.range(n)
    return vertices, vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)


def complete(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    vertices = spark.range(n)
    every = F.sequence(F.lit(1).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return vertices, _edges(vertices, F.transform(every, lambda k: F.pmod(F.col("id") + k, F.lit(n))))


def circulant(spark: SparkSession, n: int, offset: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Every vertex links to ``length`` vertices from ``offset`` on, in both directions, without doubles."""
    vertices = spark.range(n)
    steps = F.sequence(F.lit(offset).cast("bigint"), F.lit(offset + length - 1).cast("bigint"))
    pairs = _edges(vertices, F.transform(steps, lambda k: F.pmod(F.col("id") + k, F.lit(n))))
    return vertices, _both(pairs).distinct()


def cycle(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    return circulant(spark, n, 1, 1)


def path(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    vertices = spark.range(n)
    pairs = vertices.where(F.col("id") < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return vertices, _both(pairs)


def star(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    vertices = spark.range(n)
    pairs = vertices.where("id > 0").select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    return vertices, _both(pairs)


def singleton_edges(spark: SparkSession, pairs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of vertices with one edge each."""
    vertices = spark.range(2 * pairs)
    return vertices, vertices.select(F.col("id").alias("src"), F.col("id").bitwiseXOR(F.lit(1)).alias("dst"))


def hypercube(spark: SparkSession, dimensions: int) -> tuple[DataFrame, DataFrame]:
    vertices = spark.range(1 << dimensions)
    flips = F.array(*[F.col("id").bitwiseXOR(F.lit(1 << d)) for d in range(dimensions)])
    return vertices, _edges(vertices, flips)


def grid(spark: SparkSession, dimensions: list[tuple[int, bool]]) -> tuple[DataFrame, DataFrame]:
    """A grid of (size, wrap around?) dimensions."""
    total = functools.reduce(lambda a, b: a * b[0], dimensions, 1)
    vertices = spark.range(total)
    targets, stride = [], total
    for size, wraps in dimensions:
        stride //= size
        place = F.pmod(F.floor(F.col("id") / stride), F.lit(size))
        for step in (1, -1):
            moved = F.pmod(place + step, F.lit(size))
            inside = (place + step >= 0) & (place + step < size)
            allowed = (moved != place) if wraps else inside
            targets.append(F.when(allowed, F.col("id") + (moved - place) * stride))
    distinct = F.array_distinct(F.array_compact(F.array(*targets)))
    return vertices, _edges(vertices, distinct)


def echo(spark: SparkSession, n: int, degree: int) -> tuple[DataFrame, DataFrame]:
    """A regular graph, neighbours as far apart as possible; either ``n`` or ``degree`` is even, not both."""
    if (degree % 2 == 0) == (n % 2 == 0) or not 0 < degree < n:
        raise ValueError("the vertex count or the degree is even, but not both, and the degree is the smaller")
    half = n // 2
    if degree % 2:
        first = half - (degree - 1) // 2
        return circulant(spark, n, first, half - first + 1)
    return circulant(spark, n, half - degree // 2 + 1, degree // 2)


def rmat(
    spark: SparkSession, scale: int, edges: int, seed: int = 0, a: float = 0.57, b: float = 0.19, c: float = 0.19
) -> tuple[DataFrame, DataFrame]:
    """``edges`` random edges over ``2 ** scale`` vertices, by descending through quadrants.

    Every draw is a hash of (seed, edge, level), so a retried task makes the same edges.
    """
    rows = spark.range(edges)
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for level in range(scale):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(level)), F.lit(1 << 53)) / float(1 << 53)
        bottom = (draw >= a + b).cast("bigint")
        right = (((draw >= a) & (draw < a + b)) | (draw >= a + b + c)).cast("bigint")
        src, dst = src * 2 + bottom, dst * 2 + right
    pairs = rows.select(src.alias("src"), dst.alias("dst"))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends, pairs
