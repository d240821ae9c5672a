"""Ordered operators against pandas, with a key that holds most rows and with null keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, sessions, windows

ORDER = ["at", "id"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 600
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c", "d"], n))
    rows = pd.DataFrame({"k": keys, "at": rng.integers(0, 200, n), "id": np.arange(n), "v": rng.integers(-50, 50, n).astype(float)})
    rows.loc[rng.random(n) < 0.1, "v"] = np.nan
    return rows


@pytest.fixture(scope="module")
def rows(spark, frame):
    clean = frame.astype(object).where(frame.notna(), None)
    clean.loc[clean["k"] == "d", "k"] = None
    return spark.createDataFrame(clean.values.tolist(), "k string, at bigint, id bigint, v double")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def sorted_groups(frame):
    return frame.sort_values(ORDER).groupby("k", sort=False)


def same(a, b):
    return (a is None and (b is None or b != b)) or a == pytest.approx(b)


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_running(rows, frame, slices):
    spec = {"n": ("count", "*"), "s": ("sum", "v"), "hi": ("max", "v"), "m": ("avg", "v")}
    got = by_id(ordered.running(rows, ["k"], ORDER, spec, slices=slices), "n", "s", "hi", "m")
    assert len(got) == len(frame)
    for _, g in sorted_groups(frame):
        seen = []
        for i, (ident, v) in enumerate(zip(g["id"], g["v"])):
            seen += [] if v != v else [v]
            n, s, hi, m = got[ident]
            assert n == i + 1
            assert same(s, sum(seen) if seen else None)
            assert same(hi, max(seen) if seen else None)
            assert same(m, sum(seen) / len(seen) if seen else None)


def test_running_peers(rows, frame):
    got = by_id(ordered.running(rows, ["k"], ["at"], {"n": ("count", "*")}, peers=True, slices=9), "n")
    for _, g in sorted_groups(frame):
        for ident, at in zip(g["id"], g["at"]):
            assert got[ident] == ((g["at"] <= at).sum(),)


@pytest.mark.parametrize("slices", [1, 40])
def test_neighbours(rows, frame, slices):
    sliced = ordered.slice_rows(rows, ["k"], ORDER, slices)
    before = by_id(ordered.previous(sliced, ["k"], ORDER, {"p": "id"}, sliced=True), "p")
    after = by_id(ordered.following(sliced, ["k"], ORDER, {"p": "id"}, sliced=True), "p")
    marked = sliced.withColumn("m", F.when(F.col("v") > 20, F.col("id")))
    last = by_id(ordered.latest_seen(marked, ["k"], ORDER, "m", "p", sliced=True), "p")
    nxt = by_id(ordered.next_seen(marked, ["k"], ORDER, "m", "p", sliced=True), "p")
    for _, g in sorted_groups(frame):
        ids, hits = g["id"].tolist(), (g["v"] > 20).tolist()
        for i, ident in enumerate(ids):
            assert before[ident] == ((ids[i - 1] if i else None),)
            assert after[ident] == ((ids[i + 1] if i + 1 < len(ids) else None),)
            assert last[ident] == (next((ids[j] for j in range(i, -1, -1) if hits[j]), None),)
            assert nxt[ident] == (next((ids[j] for j in range(i + 1, len(ids)) if hits[j]), None),)


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_over_rows(rows, frame, block):
    got = by_id(ordered.over_rows(rows, ["k"], ORDER, 4, {"n": ("count", "*"), "hi": ("max", "id")}, block, slices=6), "n", "hi")
    assert len(got) == len(frame)
    for _, g in sorted_groups(frame):
        ids = g["id"].tolist()
        for i, ident in enumerate(ids):
            part = ids[max(0, i - 4) : i + 1]
            assert got[ident] == (len(part), max(part))


@pytest.mark.parametrize("bucket", [None, 37, 1000])
def test_over_time(rows, frame, bucket):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("at") - 100))
    got = by_id(ordered.over_time(timed, ["k"], "ts", 10, {"n": ("count", "*")}, bucket), "n")
    assert len(got) == len(frame)
    for _, g in sorted_groups(frame):
        for ident, at in zip(g["id"], g["at"]):
            assert got[ident] == (((g["at"] <= at) & (g["at"] >= at - 10)).sum(),)


def test_index_without_keys(rows, frame):
    got = by_id(ordered.numbered(rows, [], ORDER, slices=5), "idx")
    assert [got[i][0] for i in frame.sort_values(ORDER)["id"]] == list(range(len(frame)))


@pytest.mark.parametrize("slices", [1, 25])
def test_sessions(rows, frame, slices):
    timed = rows.withColumn("ts", F.timestamp_seconds("at"))
    out = sessions.sessions(timed, ["k"], "ts", ["ts", "id"], 2, {"n": ("count", "*")}, slices)
    got = sorted((r["k"] or "d", int(r["window_start"].timestamp()), int(r["window_end"].timestamp()), r["n"]) for r in out.collect())
    want = []
    for k, g in sorted_groups(frame):
        start = end = n = None
        for at in g["at"]:
            if end is None or at > end:
                if end is not None:
                    want.append((k, start, end, n))
                start, n = at, 0
            end, n = at + 2, n + 1
        want.append((k, start, end, n))
    assert got == sorted(want)


def test_session_gap_must_be_positive(rows):
    timed = rows.withColumn("ts", F.timestamp_seconds("at"))
    with pytest.raises(Exception, match="gap must be positive"):
        sessions.sessions(timed, ["k"], "ts", ["ts", "id"], 0, {"n": ("count", "*")}).collect()


def test_hop_window_assignment(spark):
    rows = spark.sql("SELECT timestamp_seconds(x) AS ts, 1 AS v FROM VALUES (-1), (0), (4999), (5000) AS t(x)")
    out = windows.hop(rows, [], "ts", 1000, 5000, {"n": ("count", "*")})
    starts = {int(r["window_start"].timestamp()): r["n"] for r in out.collect()}
    for start in range(-5000, 6000, 1000):
        assert starts.get(start, 0) == sum(start <= x < start + 5000 for x in (-1, 0, 4999, 5000))


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_over_time_of_dense_rows_has_no_sliding_frame(spark):
    """Frames are two running aggregates: sums, means and extremes agree with brute force, ties, null keys and values included."""
    import random

    random.seed(4)
    data = [(i, random.choice(["a", "b", None]), random.randrange(40), random.choice([None, 1.0, 2.5, -3.0])) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, k string, at bigint, v double").withColumn("ts", F.timestamp_seconds("at"))
    spec = {"n": ("count", "*"), "m": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v")}
    for seconds in (0, 1, 7):
        out = ordered.over_time(df, ["k"], "ts", seconds, spec)
        assert "RangeFrame, -" not in _plan(out)
        got = {r["id"]: r for r in out.collect()}
        assert len(got) == len(data)
        for i, k, at, _ in data:
            seen = [v for _, k2, at2, v in data if k2 == k and at - seconds <= at2 <= at]
            there = [v for v in seen if v is not None]
            r = got[i]
            assert (r["n"], r["m"]) == (len(seen), len(there))
            assert (r["lo"], r["hi"]) == ((min(there), max(there)) if there else (None, None))
            assert r["s"] == (pytest.approx(sum(there)) if there else None)
            assert r["mean"] == (pytest.approx(sum(there) / len(there)) if there else None)


@pytest.mark.parametrize(("size", "slide"), [(10, 4), (4, 10), (5, 5), (3, 7)])
def test_slide_rows_by_panes(spark, size, slide):
    from millrace.operators import windows

    df = spark.createDataFrame([(k, i, float(i)) for k, n in (("a", 37), ("b", 3), (None, 20)) for i in range(n)], "k string, i bigint, v double")
    out = windows.slide_rows(df, ["k"], ["i"], size, slide, {"n": ("count", "*"), "s": ("sum", "v")})
    assert f"RowFrame, -{size - 1}" not in _plan(out)
    got = {(r["k"], r["window"]): (r["n"], r["s"]) for r in out.collect()}
    want = {}
    for k, n in (("a", 37), ("b", 3), (None, 20)):
        for end in range(slide, n + 1, slide):
            part = range(max(0, end - size), end)
            want[k, end // slide - 1] = (len(part), float(sum(part)))
    assert got == want
