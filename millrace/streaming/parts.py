"""State of many keys together: keys are hashed into parts, and Python is called once for a part and micro-batch.

A call for each key costs milliseconds however few its rows are. A part's rows and state are worked on in one call, with numpy or
pandas over all its keys, and its state is kept as bytes. Rows of a part in one micro-batch, and its state, are held by a task;
``parts`` bounds both, and a micro-batch rewrites the state of the parts that it touches.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

#: How many parts keys are hashed into. A running query keeps the number it began with.
PARTS = 512
PIECE = 4 << 20
# no name begins with an underscore: Spark passes rows as named tuples
PART, NULL, NAME = "part__", "missing__", "name__"

#: ``work(rows in order, state, names) -> (rows out or None, new state)``; ``names`` are the columns that tell keys apart.
Work = Callable[[pd.DataFrame, object, list[str]], tuple[pd.DataFrame | None, object]]
Step = Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple | None]]


def named(key: str):
    """The key as text, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def packed(rows: DataFrame, keys: list[str], parts: int = PARTS) -> tuple[DataFrame, list[str]]:
    """(rows with their part, the columns that tell keys apart).

    Pandas turns whole numbers with nulls among them into doubles, so that these travel with a mark of their own; a
    null among doubles becomes NaN, so that such keys travel as text as well.
    """
    kinds, shown, names = dict(rows.dtypes), [], []
    for name, kind in rows.dtypes:
        if kind == "bigint":
            shown += [F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name), F.col(name).isNull().alias(NULL + name)]
        else:
            shown.append(F.col(name))
    for key in keys:
        if kinds[key] in ("float", "double"):
            shown.append(named(key).alias(NAME + key))
            names.append(NAME + key)
        else:
            names.append(key)
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias(PART), *shown), names


def unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows as they were before :func:`packed`."""
    out = {}
    for name in rows.columns:
        if name == PART or name.startswith(NULL):
            continue
        column = rows[name]
        if NULL + name in rows.columns:
            missing = rows[NULL + name].to_numpy(dtype=bool)
            if missing.any():
                column = pd.arrays.IntegerArray(column.to_numpy(dtype="int64"), missing.copy())
        out[name] = column.array if isinstance(column, pd.Series) else column
    return pd.DataFrame(out)


def plain(column: pd.Series) -> list:
    """Values as plain Python values, null as None."""
    return [None if empty else v for v, empty in zip(column.tolist(), column.isna().tolist(), strict=True)]


def column(values: Iterable, kind: str):
    """A column of plain values; whole numbers stay whole with nulls among them."""
    values = list(values)
    return pd.array(values, dtype="Int64") if kind in ("tinyint", "smallint", "int", "bigint") else pd.Series(values, dtype=object)


def identities(rows: pd.DataFrame, names: list[str]) -> list[tuple]:
    """The key of each row as a tuple of plain values."""
    return list(zip(*(plain(rows[name]) for name in names), strict=True))


def floats(column: pd.Series) -> np.ndarray:
    """Numbers as doubles, null as NaN."""
    return column.to_numpy(dtype="float64", na_value=np.nan)


def by_key(state: pd.DataFrame | None, rows: pd.DataFrame, names: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(rows of the state, then new ones, key by key; the number of each row's key; whether the row is new).

    The order of a key's rows stays as it was.
    """
    old = 0 if state is None else len(state)
    both = pd.concat([state, rows], ignore_index=True) if old else rows.reset_index(drop=True)
    code = both.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    place = np.argsort(code, kind="stable")
    return both.iloc[place].reset_index(drop=True), code[place], place >= old


def each_key(step: Step, keys: list[str]) -> Work:
    """``step(key, rows in order, state) -> (rows out, new state)`` for every key of a part. A state of None clears the key."""

    def work(rows, state, names):
        held, out = state or {}, []
        for _, mine in rows.groupby(names, sort=False, dropna=False):
            mine = mine.reset_index(drop=True)
            ident = identities(mine[:1], names)[0]
            found, new = step(identities(mine[:1], keys)[0], mine, held.get(ident))
            if new is None:
                held.pop(ident, None)
            else:
                held[ident] = new
            if len(found):
                out.append(found)
        return (pd.concat(out, ignore_index=True) if out else None), held or None

    return work


class Piles:
    """Objects by name in one map of a store, in entries of a bounded size; added to without reading what is there.

    One map for all of them: every further one costs each partition of the state a commit of its own.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.entries = handle.getMapState("entries", "pile string, place int", "body binary")

    def size(self, pile: str) -> int:
        """Number of entries, which the entry before the first holds."""
        held = self.entries.getValue((pile, -1))
        return int(bytes(held[0])) if held is not None else 0

    def add(self, pile: str, thing: object, begin: int | None = None) -> int:
        body, place = pickle.dumps(thing, pickle.HIGHEST_PROTOCOL), self.size(pile) if begin is None else begin
        for i in range(0, len(body), PIECE):
            self.entries.updateValue((pile, place), (body[i : i + PIECE],))
            place += 1
        self.entries.updateValue((pile, -1), (str(place).encode(),))
        return place

    def get(self, pile: str) -> list:
        body = io.BytesIO(b"".join(bytes(self.entries.getValue((pile, i))[0]) for i in range(self.size(pile))))
        end, out = body.getbuffer().nbytes, []
        while body.tell() < end:
            out.append(pickle.load(body))
        return out

    def put(self, pile: str, thing: object | None) -> None:
        """``thing`` in place of all; None empties the pile."""
        before = self.size(pile)
        after = self.add(pile, thing, 0) if thing is not None else 0
        for i in range(after, before):
            self.entries.removeKey((pile, i))
        if not after and before:
            self.entries.removeKey((pile, -1))
