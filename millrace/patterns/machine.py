"""A state machine run over each key's events, split at any row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.scratch import written


def illegal_transitions(
    df: DataFrame, key: str, order: list[str], symbol: str, transitions: dict[tuple[str, str], str], initial: str
) -> DataFrame:
    """Rows whose symbol is not allowed in the state reached so far, with that state.

    An illegal symbol leaves the state as it is; a state without a way out starts the machine afresh.

    The effect of any stretch of events is a map from state to state, and such maps compose. Each slice
    of a key is read once to get its map; composing the maps of a key's earlier slices (no more rows
    than slices) gives the state a slice begins in, and a second read finds the alerts. Rows stream
    through; only one state per possible start is held.
    """
    leads_on = {a for a, _ in transitions}
    states = sorted({initial, *leads_on})
    place = {state: i for i, state in enumerate(states)}
    step = {}
    for (state, what), after in transitions.items():
        step[state, what] = after if after in leads_on else initial
    kind = dict(df.dtypes)[key]
    rows = ordered.slice_rows(df, [key], order)
    sorted_rows = rows.repartition(ordered.SLICE, key).sortWithinPartitions(ordered.SLICE, key, *order)

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, []
        for batch in batches:
            out = []
            for piece, who, what in zip(batch[ordered.SLICE], batch[key], batch[symbol], strict=True):
                if at != (piece, who):
                    if at is not None:
                        out.append((*at, now))
                    at, now = (piece, who), states
                now = [step.get((state, what), state) for state in now]
            yield pd.DataFrame(out, columns=[ordered.SLICE, key, "after"])
        if at is not None:
            yield pd.DataFrame([(*at, now)], columns=[ordered.SLICE, key, "after"])

    def begins_in(maps: pd.DataFrame) -> pd.DataFrame:
        state, out = initial, []
        for after in maps.sort_values(ordered.SLICE)["after"]:
            out.append(state)
            state = after[place[state]]
        return maps.sort_values(ordered.SLICE).assign(_begin=out)[[ordered.SLICE, key, "_begin"]].iloc[1:]

    maps = written(sorted_rows.mapInPandas(effects, f"{ordered.SLICE} int, {key} {kind}, after array<string>"), "maps")
    split = maps.groupBy(key).agg(F.count(F.lit(1)).alias("_pieces")).where("_pieces > 1").select(key)
    begins = maps.join(split, key, "left_semi").groupBy(key).applyInPandas(
        begins_in, f"{ordered.SLICE} int, {key} {kind}, _begin string"
    )
    # at most one key continues into a slice, so this side has fewer rows than there are slices
    told = rows.join(F.broadcast(begins), [ordered.SLICE, key], "left").select(*rows.columns, "_begin")
    told = told.repartition(ordered.SLICE, key).sortWithinPartitions(ordered.SLICE, key, *order)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != ordered.SLICE) + ", state string"

    def alerts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, initial
        for batch in batches:
            hits, found = [], []
            names = (ordered.SLICE, key, symbol, "_begin")
            for i, (piece, who, what, begin) in enumerate(zip(*[batch[n] for n in names], strict=True)):
                if at != (piece, who):
                    at, now = (piece, who), begin or initial
                if (now, what) in step:
                    now = step[now, what]
                else:
                    hits.append(i)
                    found.append(now)
            yield batch.iloc[hits].drop(columns=[ordered.SLICE, "_begin"]).assign(state=found)

    return told.mapInPandas(alerts, schema)
