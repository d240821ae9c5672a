"""Event-time operators on streams: the same rows however the input is cut into micro-batches."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.streaming import eventtime, keyed, run

BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """(step, key, ident, minutes, value): out of order by up to an hour, with ties, nulls and a key on most rows."""
    rng = random.Random(3)
    out = []
    for i in range(120):
        minute = i * 3 - rng.randrange(60) if i > 20 else i // 2
        key = rng.choice(["a", "a", "a", "a", "b", None])
        out.append((i // 30, key, i, max(minute, 0), None if i % 11 == 0 else float(rng.randrange(100))))
    return out


def streamed(spark, rows, cuts):
    """The rows in ``cuts`` micro-batches, and what to call at their end."""
    table = [(r[0], r[1], r[2], BEGIN + dt.timedelta(minutes=r[3]), r[4]) for r in rows]
    frame = spark.createDataFrame(table, "step int, k string, id bigint, t timestamp, v double")
    steps = ["step >= 0"] if cuts == 1 else [f"step = {i}" for i in range(4)]
    stream, finish = run.ending(run.replay(frame, steps).drop("step"), "t")
    return stream.withWatermark("t", "70 minutes"), finish


def test_extremes_by_spans():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 70).astype(float)
    low = rng.integers(0, 70, 200)
    high = np.minimum(70, low + rng.integers(1, 70, 200))
    got = eventtime.framed(values, low, high)
    assert got["low"].tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]
    assert got["high"].tolist() == [values[a:b].max() for a, b in zip(low, high, strict=True)]
    assert np.allclose(got["total"], [values[a:b].sum() for a, b in zip(low, high, strict=True)])


@pytest.mark.parametrize("cuts", [1, 4])
@pytest.mark.parametrize("frame", [{"rows": 2}, {"micros": 30 * 60_000_000}])
def test_frames_like_brute_force(spark, rows, cuts, frame):
    stream, finish = streamed(spark, rows, cuts)
    with run.rocksdb_state(spark):
        out = run.append_table(eventtime.over(stream, "k", "t", ["id"], "v", ["id"], **frame), finish=finish)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        mine = sorted((r[3], r[2], r[4]) for r in rows if r[1] == key)
        for place, (minute, ident, _) in enumerate(mine):
            span = mine[max(0, place - 2) : place + 1] if "rows" in frame else [m for m in mine if minute - 30 <= m[0] <= minute]
            seen, r = [m[2] for m in span if m[2] is not None], got[ident]
            assert (r["k"], r["n"], r["low"], r["high"]) == (key, len(seen), min(seen, default=None), max(seen, default=None))
            assert r["total"] == (pytest.approx(sum(seen)) if seen else None)
            assert r["deviation"] == (pytest.approx(statistics.stdev(seen), abs=1e-6) if len(seen) > 1 else None)


def test_frame_is_rows_or_time(spark, rows):
    stream, _ = streamed(spark, rows, 1)
    with pytest.raises(ValueError):
        eventtime.over(stream, "k", "t", ["id"], "v", ["id"])


@pytest.mark.parametrize("cuts", [1, 4])
def test_count_windows_in_event_time(spark, rows, cuts):
    full = [r for r in rows if r[4] is not None]
    stream, finish = streamed(spark, full, cuts)
    stream = stream.withColumn("k", F.expr("CASE k WHEN 'a' THEN 0 WHEN 'b' THEN 1 END").cast("bigint"))  # a null among numbers
    with run.rocksdb_state(spark):
        out = run.append_table(keyed.count_windows(stream, "k", ["id"], "v", 5, "t"), finish=finish)
    expected = set()
    for key in ("a", "b", None):
        values = [v for _, _, v in sorted((r[3], r[2], r[4]) for r in full if r[1] == key)]
        expected |= {({"a": 0, "b": 1}.get(key), i, sum(values[5 * i : 5 * i + 5])) for i in range(len(values) // 5)}
    assert {tuple(r) for r in out.collect()} == expected


def test_late_rows_fire_again_until_lateness(spark):
    def at(hour):
        return BEGIN + dt.timedelta(hours=hour)

    # the watermark runs an hour behind; windows of two hours, two hours of lateness
    steps = [(0, "a", at(0.5), 1.0), (0, "a", at(3.5), 2.0), (1, "a", at(1.0), 4.0), (1, "a", at(5.5), 8.0), (2, "a", at(1.5), 16.0), (2, "a", at(3.0), 32.0), (0, None, at(0.5), 64.0)]

    def fired(**rules):
        frame = spark.createDataFrame(steps, "step int, k string, t timestamp, v double")
        stream, finish = run.ending(run.replay(frame, [f"step = {i}" for i in range(3)]).drop("step"), "t")
        with run.rocksdb_state(spark):
            out = run.append_table(eventtime.triggered(stream, "k", "t", "v", 7200, 3600, 7200, **rules), finish=finish)
        begin = int(BEGIN.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        return sorted(((r["start"] - begin) // 3_600_000, r["firing"], r["n"], r["total"]) for r in out.collect() if r["k"] or r["start"] == begin)

    # the first window is past its lateness when 16 comes (watermark 4.5); the second has fired and takes 32
    assert fired() == [(0, 0, 1, 1.0), (0, 0, 1, 64.0), (0, 1, 2, 5.0), (2, 0, 1, 2.0), (2, 1, 2, 34.0), (4, 0, 1, 8.0)]
    assert fired(purge=True) == [(0, 0, 1, 1.0), (0, 0, 1, 64.0), (0, 1, 1, 4.0), (2, 0, 1, 2.0), (2, 1, 1, 32.0), (4, 0, 1, 8.0)]


def test_marks_release_up_to_the_least_of_the_sources(spark):
    table = [(s, i, BEGIN + dt.timedelta(minutes=m), mark) for s, i, m, mark in [
        ("x", 0, 5, False), ("x", 1, 20, True), ("x", 2, 12, False), ("y", 3, 7, False), ("y", 4, 10, True), ("y", 5, 10, False), ("y", 6, 40, False)]]
    frame = spark.createDataFrame(table, "s string, id bigint, t timestamp, mark boolean")
    parts = [eventtime.marked(run.replay(frame.where(F.col("s") == name), ["true"]), F.when(F.col("mark"), F.col("t"))) for name in "xy"]

    def step(name, new, state):
        return new[["id"]], (1,)

    both = parts[0].unionByName(parts[1]).withColumn("g", F.lit(1))
    with run.rocksdb_state(spark):
        out = run.append_table(eventtime.in_order(both, "g", "t", ["id"], step, "id bigint", "n bigint"))
    assert {r["id"] for r in out.collect()} == {0, 3}


@pytest.mark.parametrize("copies", [1, 3])
def test_rules_hold_from_their_time_on(spark, copies):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        kind = rng.choice(["set", "drop", "event", "event", "event", "other"])
        rows.append((i // 50, i, BEGIN + dt.timedelta(minutes=max(0, 2 * i - rng.randrange(40))), kind, rng.randrange(4), float(rng.randrange(50))))
    frame = spark.createDataFrame(rows, "step int, id bigint, t timestamp, kind string, rule bigint, v double")
    stream, finish = run.ending(run.replay(frame, [f"step = {i}" for i in range(3)]), "t")
    kind = F.col("kind")
    found = eventtime.judged(
        stream.withWatermark("t", "1 hour"), "t", F.when(kind.isin("set", "drop"), F.col("rule")), F.when(kind == "set", F.col("v")), kind == "event", "id", "v", copies
    )
    with run.rocksdb_state(spark):
        got = sorted(tuple(r) for r in run.append_table(found, finish=finish).collect())
    valid, expected = {}, []
    for _, ident, _, kind, rule, v in sorted(rows, key=lambda r: (r[2], r[3] == "event", r[1])):
        if kind == "set":
            valid[rule] = v
        elif kind == "drop":
            valid.pop(rule, None)
        elif kind == "event":
            expected += [(ident, r, b) for r, b in valid.items() if v > b]
    assert got == sorted(expected) and got
