"""Date and time functions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format codes of DATE_FORMAT and the Java pattern of each.
FORMAT_CODES = {
    "a": "EEE",
    "b": "MMM",
    "c": "M",
    "d": "dd",
    "e": "d",
    "f": "SSSSSS",
    "H": "HH",
    "h": "hh",
    "I": "hh",
    "i": "mm",
    "j": "DDD",
    "k": "H",
    "l": "h",
    "M": "MMMM",
    "m": "MM",
    "p": "a",
    "r": "hh:mm:ss a",
    "S": "ss",
    "s": "ss",
    "T": "HH:mm:ss",
    "W": "EEEE",
    "Y": "yyyy",
    "y": "yy",
}
# Format codes that are refused.
REFUSED_CODES = "wUuVXD"

MICROS = {"SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000, "WEEK": 604_800_000_000}
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def _code(ts: Column, code: str) -> Column:
    if code == "v":
        return F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    if code == "x":
        return F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0")
    return F.date_format(ts, FORMAT_CODES[code])


def date_format(ts: Column, pattern: str | Column) -> Column:
    """DATE_FORMAT with ``%`` codes; the pattern may be a constant or a column."""
    if isinstance(pattern, Column):
        return _date_format_column(ts, pattern)
    pieces, literal, i = [], "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "%" and i + 1 < len(pattern):
            i += 1
            code = pattern[i]
            if code in REFUSED_CODES:
                raise ValueError(f"%{code} is not supported in a date format")
            if code in FORMAT_CODES or code in "vx":
                if literal:
                    pieces.append(F.lit(literal))
                    literal = ""
                pieces.append(_code(ts, code))
            else:
                literal += code
        elif ch != "%":
            literal += ch
        i += 1
    if literal or not pieces:
        pieces.append(F.lit(literal))
    return F.concat(*pieces)


def _date_format_column(ts: Column, pattern: Column) -> Column:
    def expand(part: Column) -> Column:
        for code in [*FORMAT_CODES, "v", "x"]:
            part = F.replace(part, F.lit(f"%{code}"), _code(ts, code))
        bad = F.raise_error(F.lit("unsupported code in a date format")).cast("string")
        return F.when(part.rlike(f"%[{REFUSED_CODES}]"), bad).otherwise(F.regexp_replace(part, "%(.)", "$1"))

    return F.array_join(F.transform(F.split(pattern, "%%"), expand), "%")


def extract(unit: str, ts: Column) -> Column:
    """EXTRACT as bigint; the week starts on Sunday = 1 for DOW, CENTURY and MILLENNIUM count from year 1."""
    unit = unit.upper()
    if unit in ("CENTURY", "MILLENNIUM"):
        span = 100 if unit == "CENTURY" else 1000
        return F.ceil(F.year(ts) / span).cast("bigint")
    if unit == "DOW":
        return F.dayofweek(ts).cast("bigint")
    if unit == "SECOND":
        return F.second(ts).cast("bigint")
    return F.extract(F.lit(unit), ts).cast("bigint")


def floor_time(ts: Column, unit: str) -> Column:
    """FLOOR(t TO unit). Weeks are whole multiples of seven days since the epoch; result is TIMESTAMP_NTZ."""
    unit = unit.upper()
    if unit in MONTHS:
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(MICROS[unit]))).cast("timestamp_ntz")


def ceil_time(ts: Column, unit: str) -> Column:
    """CEIL(t TO unit): the floor, one unit later unless the time is already on the boundary."""
    unit = unit.upper()
    low = floor_time(ts, unit)
    return F.when(low == ts.cast("timestamp_ntz"), low).otherwise(timestamp_add(unit, F.lit(1), low))


def timestamp_add(unit: str, amount: Column, ts: Column) -> Column:
    """TIMESTAMPADD; the result keeps TIMESTAMP_NTZ."""
    unit = unit.upper()
    if unit in MONTHS:
        return ts + F.make_ym_interval(F.lit(0), (amount * MONTHS[unit]).cast("int"))
    seconds = (amount * (MICROS[unit] // 1_000_000)).cast("decimal(18,6)")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def timestamp_diff(unit: str, begin: Column, end: Column) -> Column:
    """TIMESTAMPDIFF(unit, begin, end): whole units, truncated toward zero, as int."""
    unit = unit.upper()
    if unit in MONTHS:
        months = F.timestamp_diff("MONTH", begin, end)
        return F.call_function("div", months, F.lit(MONTHS[unit])).cast("int")
    span = F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))
    return F.call_function("div", span, F.lit(MICROS[unit])).cast("int")


def overlaps(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    """Do two time ranges share a point? Ends may come in either order; touching counts."""
    return (F.greatest(a_begin, a_end) >= F.least(b_begin, b_end)) & (
        F.greatest(b_begin, b_end) >= F.least(a_begin, a_end)
    )


def to_millis(ts: Column) -> Column:
    """Epoch milliseconds of a time (default precision of a time here is 3)."""
    return F.unix_millis(ts.cast("timestamp"))


def time_of_day(ts: Column) -> Column:
    """TIME values are kept as milliseconds since midnight."""
    return F.pmod(to_millis(ts), F.lit(86_400_000))


def rowtime(column: Column, kind: str) -> Column:
    """A rowtime from an existing bigint (ms), timestamp or ISO text field."""
    if kind == "bigint":
        return F.timestamp_millis(column)
    return column.cast("timestamp")


def any_of(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)
