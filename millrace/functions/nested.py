"""Arrays, maps and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(array: Column, index: int) -> Column:
    """``a[i]`` with a 1-based index; out of range and null arrays give null."""
    return F.try_element_at(array, F.lit(index))


def lookup(mapping: Column, key) -> Column:
    """``m[k]``; a missing key gives null."""
    return F.try_element_at(mapping, key if isinstance(key, Column) else F.lit(key))


def cardinality(value: Column) -> Column:
    """Number of elements; null for a null collection."""
    return F.when(value.isNotNull(), F.size(value))


def element(array: Column) -> Column:
    """The only element of an array; null when empty, an error when there are more."""
    many = F.size(array) > 1
    return F.when(many, F.element_at(array, F.raise_error(F.lit("ELEMENT needs at most one value")).cast("int"))).otherwise(
        F.try_element_at(array, F.lit(1))
    )


def map_equals(a: Column, b: Column) -> Column:
    """Equality of maps, whatever the order of their entries."""
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
