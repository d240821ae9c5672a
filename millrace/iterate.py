"""Iterative dataflow: bulk and delta iterations over written tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import drop, written, written_and_measured


def fingerprint(columns: list[str]) -> Column:
    """Order-free digest of a table, to see whether a round changed anything."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def bulk_iterate(
    start: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    max_rounds: int | None,
    converged: dict[str, Column] | None = None,
    stop: Callable[[dict, dict | None], bool] | None = None,
    label: str = "bulk",
) -> tuple[DataFrame, int]:
    """Run ``step(state, round)`` until ``stop(measures, earlier measures)``, or for ``max_rounds`` rounds.

    The measures are aggregates observed while a round is written, so the test costs no extra job.
    Without ``max_rounds`` only ``stop`` ends the loop. The table of a round is removed when the next
    one is written.
    """
    if max_rounds is None and stop is None:
        raise ValueError("a loop needs a number of rounds or a test that ends it")
    measures = {"_rows": F.count(F.lit(1)), **(converged or {})}
    state, seen = written_and_measured(start, label, **{k: v for k, v in measures.items() if k == "_rows"})
    before: dict | None = None
    for turn in itertools.count(1):
        if max_rounds is not None and turn > max_rounds:
            break
        earlier = state
        state, seen = written_and_measured(step(earlier, turn), label, **measures)
        drop(earlier)
        if stop is not None and stop(seen, before):
            return state, turn
        before = seen
    return state, max_rounds


def until_unchanged(
    start: DataFrame, step: Callable[[DataFrame, int], DataFrame], max_rounds: int | None = None, label: str = "fixpoint"
) -> tuple[DataFrame, int]:
    """Bulk iteration that ends when a round leaves the table as it was; it raises if ``max_rounds`` do not suffice."""
    ended = False

    def same(seen: dict, before: dict | None) -> bool:
        nonlocal ended
        ended = before is not None and seen == before
        return ended

    out = bulk_iterate(start, step, max_rounds, {"_digest": fingerprint(start.columns)}, same, label)
    if not ended:
        raise RuntimeError(f"the table still changes after {max_rounds} rounds")
    return out


def delta_iterate(
    solution: DataFrame,
    workset: DataFrame,
    key: str,
    improve: Callable[[DataFrame, DataFrame, int], DataFrame],
    max_rounds: int | None = None,
) -> tuple[DataFrame, int]:
    """``improve(workset, solution, round)`` gives changed solution rows; they are the next workset.

    The solution is keyed by ``key``; changed rows replace the old ones. Ends on an empty workset, and
    raises if there still is one after ``max_rounds``.
    """
    solution, workset = written(solution, "solution"), written(workset, "workset")
    columns = solution.columns
    for turn in itertools.count(1):
        if max_rounds is not None and turn > max_rounds:
            raise RuntimeError(f"rows still change after {max_rounds} rounds")
        earlier = workset
        workset, seen = written_and_measured(improve(earlier, solution, turn), "workset")
        drop(earlier)
        if seen["rows"] == 0:
            return solution, turn
        kept = solution.join(workset.select(key).hint("merge"), key, "left_anti")
        merged = written(kept.select(*columns).unionByName(workset.select(*columns)), "solution")
        drop(solution)
        solution = merged
