"""State of many keys together: one call of Python for a part of the keys, whatever the keys are."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from millrace.streaming import eventtime, keyed, parts, retract, run, temporal


class Entries(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getMapState(self, name, key, value):
        return Entries()


def test_piles_hold_more_than_an_entry(monkeypatch):
    monkeypatch.setattr(parts, "PIECE", 10)
    piles = parts.Piles(Handle())
    assert piles.get("a") == []
    piles.add("a", list(range(50)))
    piles.add("a", "second")
    piles.add("b", 1)
    assert piles.get("a") == [list(range(50)), "second"]
    piles.put("a", 2)
    assert piles.get("a") == [2]
    piles.put("a", None)
    assert piles.get("a") == [] and piles.get("b") == [1]
    piles.put("b", None)
    assert not piles.entries


def test_each_key_keeps_its_own_state():
    work = parts.each_key(lambda key, rows, state: (rows.assign(key=str(key[0])), None if key[0] == 2 else (len(rows) + (state or (0,))[0],)), ["k"])
    rows = pd.DataFrame({"k": pd.array([1, None, 2, 1], dtype="Int64")})
    out, state = work(rows, None, ["k"])
    assert sorted(out["key"]) == ["1", "1", "2", "None"] and state == {(1,): (2,), (None,): (1,)}
    assert work(rows, state, ["k"])[1] == {(1,): (4,), (None,): (2,)}


def test_frames_of_many_keys_begin_anew():
    values, code = np.array([1e12, 1e12 + 1, 40.27, 40.27, 40.27]), np.array([0, 0, 1, 1, 1])
    got = eventtime.framed(values, np.array([0, 0, 2, 2, 3]), np.array([1, 2, 3, 4, 5]), code)
    assert got["n"].tolist() == [1, 2, 1, 2, 2]
    assert got["deviation"][3:].tolist() == [0.0, 0.0]  # sums that ran on from the first key would not give zero


@pytest.mark.parametrize("kind", ["over", "count", "delta", "rolling", "changelog", "join", "aggregate", "as_of", "in_order"])
def test_python_is_called_for_parts(spark, kind):
    """Grouped by the key itself, each key and micro-batch was a call of its own."""
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, 2.0, 1)], "k bigint, t timestamp, id bigint, v double, sign int")
    stream = run.replay(rows, ["true"])
    timed = stream.withWatermark("t", "1 hour")
    out = {
        "over": lambda: eventtime.over(timed, "k", "t", ["id"], "v", ["id"], rows=2),
        "count": lambda: keyed.count_windows(timed, "k", ["id"], "v", 2, "t"),
        "delta": lambda: keyed.delta_windows(stream, "k", ["id"], "id", "v", "v", 1.0, 5),
        "rolling": lambda: keyed.rolling(stream, "k", ["id"], "v", ["id"]),
        "changelog": lambda: keyed.changelog(stream, "k", "v"),
        "join": lambda: retract.join(stream, stream, "k", "id"),
        "aggregate": lambda: retract.aggregate(stream, "k", "v"),
        "as_of": lambda: temporal.as_of_join(temporal.tagged(timed, "k", "t", stream["v"] > 1, stream["v"] <= 1, "id", "v"), "k"),
        "in_order": lambda: eventtime.in_order(timed, "k", "t", ["id"], lambda key, new, state: (new[["id"]], None), "id bigint", "n bigint"),
    }[kind]()
    assert parts.PART in out._jdf.queryExecution().analyzed().toString()
