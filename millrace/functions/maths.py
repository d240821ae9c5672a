"""Number functions whose rules differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def refuse(condition: Column, message: str, otherwise: Column) -> Column:
    """``otherwise`` unless ``condition`` holds, which raises."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("double")).otherwise(otherwise)


def strict_log(x: Column, base: Column | None = None) -> Column:
    """LOG(x) or LOG(base, x); raises for x <= 0 and for base <= 1 instead of giving null."""
    if base is None:
        return refuse(x <= 0, "LOG needs x > 0", F.ln(x))
    return refuse((x <= 0) | (base <= 1), "LOG needs x > 0 and base > 1", F.ln(x) / F.ln(base))


def divide_whole(a: Column, b: Column) -> Column:
    """``/`` on whole numbers truncates toward zero."""
    return F.call_function("div", a, b)


def truncate(x: Column, places: int = 0) -> Column:
    """Cut digits after ``places``, toward zero, on the decimal digits of the number."""
    exact = x.cast("decimal(38,12)")
    down = F.when(x >= 0, F.floor(exact, F.lit(places))).otherwise(F.ceil(exact, F.lit(places)))
    return down.cast("double")


def floor_keep(x: Column, kind: str) -> Column:
    """FLOOR that keeps the input type (a no-op on whole numbers)."""
    return x if kind in ("tinyint", "smallint", "int", "bigint") else F.floor(x).cast(kind)


def ceil_keep(x: Column, kind: str) -> Column:
    return x if kind in ("tinyint", "smallint", "int", "bigint") else F.ceil(x).cast(kind)


def rand_integer(bound: int, seed: int | None = None) -> Column:
    return F.floor((F.rand(seed) if seed is not None else F.rand()) * bound).cast("int")


def sha2_checked(x: Column, bits: int) -> Column:
    if bits not in (224, 256, 384, 512):
        raise ValueError("SHA2 takes 224, 256, 384 or 512 bits")
    return F.sha2(x, bits)
