"""Aggregates that can be computed in pieces and merged.

A spec is ``{"total": ("sum", "value"), "n": ("count", "*")}``. Each entry becomes one or more part
columns, so callers may aggregate per slice, pane or salt first and merge the (few) parts later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("count", "sum", "min", "max", "avg")


class Partials:
    def __init__(self, spec: dict[str, tuple[str, str]]):
        for name, (kind, _) in spec.items():
            if kind not in KINDS:
                raise ValueError(f"{name}: {kind} cannot be merged; use one of {KINDS}")
        self.spec = spec

    def _pieces(self):
        """(part column, kind of the part, input column) for every part."""
        for name, (kind, column) in self.spec.items():
            if kind == "avg":
                yield f"_{name}_sum", "sum", column
                yield f"_{name}_count", "count", column
            else:
                yield f"_{name}_{kind}", kind, column

    @property
    def names(self) -> list[str]:
        return [part for part, _, _ in self._pieces()]

    def first(self, wrap: Callable[[Column], Column] = lambda c: c) -> list[Column]:
        """Part columns straight from rows; ``wrap`` may add ``.over(window)``."""
        out = []
        for part, kind, column in self._pieces():
            source = F.lit(1) if column == "*" else F.col(column)
            out.append(wrap(getattr(F, kind)(source)).alias(part))
        return out

    def merge(self, wrap: Callable[[Column], Column] = lambda c: c) -> list[Column]:
        """Part columns from part columns."""
        out = []
        for part, kind, _ in self._pieces():
            step = "sum" if kind == "count" else kind
            out.append(wrap(getattr(F, step)(part)).alias(part))
        return out

    def join(self, left: str, right: str) -> list[Column]:
        """Parts of two disjoint row sets, held in ``left.*`` and ``right.*`` structs, as one."""
        out = []
        for part, kind, _ in self._pieces():
            a, b = F.col(f"{left}.{part}"), F.col(f"{right}.{part}")
            if kind in ("min", "max"):
                both = F.least(a, b) if kind == "min" else F.greatest(a, b)
            else:
                both = F.coalesce(a + b, a, b)
            out.append(both.alias(part))
        return out

    def finish(self) -> list[Column]:
        """The asked-for columns from merged parts."""
        out = []
        for name, (kind, _) in self.spec.items():
            if kind == "avg":
                value = F.try_divide(F.col(f"_{name}_sum"), F.col(f"_{name}_count"))
            elif kind == "count":
                value = F.coalesce(F.col(f"_{name}_count"), F.lit(0)).cast("bigint")
            else:
                value = F.col(f"_{name}_{kind}")
            out.append(value.alias(name))
        return out
