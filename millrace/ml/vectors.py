"""Vector distances, scaling and features on ARRAY columns, all in built-in functions."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _gaps(a: Column, b: Column, power: float) -> Column:
    def gap(x, y):
        diff = x.cast("double") - y.cast("double")
        return diff * diff if power == 2 else (F.abs(diff) if power == 1 else F.pow(F.abs(diff), F.lit(float(power))))

    return _sum(F.zip_with(a, b, gap))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _gaps(a, b, 2)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_gaps(a, b, 2))


def manhattan(a: Column, b: Column) -> Column:
    return _gaps(a, b, 1)


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_gaps(a, b, p), F.lit(1.0 / p))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tanimoto(a: Column, b: Column) -> Column:
    both = dot(a, b)
    return 1 - both / (dot(a, a) + dot(b, b) - both)


def per_dimension(df: DataFrame, vector: str, keys: list[str] | None = None, **aggregates: Callable[[Column], Column]) -> DataFrame:
    """One array per aggregate, indexed by dimension. Dimensions are reduced on the map side first."""
    keys = keys or []
    items = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    x = F.col("_x").cast("double")
    stats = items.groupBy(*keys, "_pos").agg(*[fn(x).alias(name) for name, fn in aggregates.items()])
    listed = F.array_sort(F.collect_list(F.struct("_pos", *aggregates)))
    rows = stats.groupBy(*keys).agg(listed.alias("_all"))

    def part(name: str) -> Column:
        return F.transform("_all", lambda e: e[name]).alias(name)

    return rows.select(*keys, *[part(name) for name in aggregates])


class StandardScaler:
    """To a mean and a (population) standard deviation; constant dimensions keep a divisor of 1."""

    def __init__(self, vector: str, mean: float = 0.0, std: float = 1.0):
        self.vector, self.mean, self.std = vector, mean, std

    def fit(self, df: DataFrame):
        stats = per_dimension(df, self.vector, m=F.avg, s=F.stddev_pop)
        means, spreads = stats.select("m").scalar(), stats.select("s").scalar()

        def apply(rows: DataFrame) -> DataFrame:
            centred = F.zip_with(_doubles(F.col(self.vector)), "_m", lambda x, m: x - m)
            scaled = F.zip_with(centred, "_s", lambda x, s: x / F.when(s == 0, 1.0).otherwise(s) * self.std + self.mean)
            return rows.withColumn("_m", means).withColumn("_s", spreads).withColumn(self.vector, scaled).drop("_m", "_s")

        return apply


class MinMaxScaler:
    """To a range, by the least and greatest value of each dimension."""

    def __init__(self, vector: str, low: float = 0.0, high: float = 1.0):
        self.vector, self.low, self.high = vector, low, high

    def fit(self, df: DataFrame):
        stats = per_dimension(df, self.vector, lo=F.min, hi=F.max)
        lows, highs = stats.select("lo").scalar(), stats.select("hi").scalar()

        def apply(rows: DataFrame) -> DataFrame:
            shifted = F.zip_with(_doubles(F.col(self.vector)), "_lo", lambda x, lo: x - lo)
            width = F.zip_with("_hi", "_lo", lambda hi, lo: F.when(hi == lo, 1.0).otherwise(hi - lo))
            scaled = F.zip_with(shifted, width, lambda x, w: x / w * (self.high - self.low) + self.low)
            return rows.withColumn("_lo", lows).withColumn("_hi", highs).withColumn(self.vector, scaled).drop("_lo", "_hi")

        return apply


class PolynomialFeatures:
    """All products of up to ``degree`` factors, highest degree first."""

    def __init__(self, vector: str, size: int, degree: int):
        self.vector, self.size, self.degree = vector, size, degree

    def fit(self, df: DataFrame):
        def apply(rows: DataFrame) -> DataFrame:
            products = []
            for degree in range(self.degree, 0, -1):
                for factors in itertools.combinations_with_replacement(range(self.size), degree):
                    product = F.lit(1.0)
                    for place in factors:
                        product = product * F.col(self.vector)[place].cast("double")
                    products.append(product)
            return rows.withColumn(self.vector, F.array(*products))

        return apply


class Chain:
    """Transformers fitted one after the other, each on the output of those before it."""

    def __init__(self, *steps):
        self.steps = steps

    def fit(self, df: DataFrame):
        fitted = []
        for step in self.steps:
            made = step.fit(df)
            df = made(df)
            fitted.append(made)

        def apply(rows: DataFrame) -> DataFrame:
            for made in fitted:
                rows = made(rows)
            return rows

        return apply
