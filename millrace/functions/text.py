"""Text predicates and formats that Spark spells differently."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar_to(column: Column, pattern: str, escape: str | None = None) -> Column:
    """SQL ``SIMILAR TO``: whole-string match with ``%``, ``_``, ``|``, ``*``, ``+``, ``?``, groups and classes."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if escape and ch == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch in ".^$\\":
            out.append("\\" + ch)
        elif ch == "[":
            end = pattern.index("]", i)
            out.append(pattern[i : end + 1])
            i = end
        else:
            out.append(ch)
        i += 1
    return column.rlike("(?s)^(?:" + "".join(out) + ")$")


def initcap(column: Column) -> Column:
    """First letter of each run of letters and digits in upper case, the rest in lower case."""
    words = F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def unicode_literal(body: str, escape: str = "\\") -> Column:
    """``U&'...' UESCAPE '...'``: four hex digits after the escape, or a plus sign and six; the escape twice is itself."""
    if len(escape) != 1 or escape in "+'\"" or escape.isalnum() or escape.isspace():
        raise ValueError("the escape is one character, no digit, letter, quote, plus sign or space")
    mark = re.escape(escape)
    code = re.compile(rf"{mark}(?:({mark})|\+([0-9A-Fa-f]{{6}})|([0-9A-Fa-f]{{4}}))")
    if escape in code.sub("", body):
        raise ValueError("an escape is followed by itself, by four hex digits or by a plus sign and six")

    def character(match: re.Match) -> str:
        point = int(match[2] or match[3], 16) if not match[1] else ord(escape)
        if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
            raise ValueError(f"{match[0]} is no character")
        return chr(point)

    return F.lit(code.sub(character, body))
