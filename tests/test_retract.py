"""Changelogs through joins and aggregates, and as-of joins, over several micro-batches."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.streaming import keyed, retract, run, temporal

STEPS = [f"step = {i}" for i in range(4)]
CHANGE = "step int, k string, at bigint, v bigint, sign int"


@pytest.fixture(scope="module")
def changes():
    """Additions, and some of them taken back in the same step or later."""
    rng = random.Random(5)

    def rows(n):
        out = []
        for i in range(n):
            step = rng.randrange(4)
            row = (rng.choice("abcd"), rng.randrange(6))
            out.append((step, row[0], 10 * step + 1, row[1], 1))
            if rng.random() < 0.5:
                gone = rng.randrange(step, 4)
                out.append((gone, row[0], 10 * gone + 2, row[1], -1))
        return out

    return rows


def left_over(rows):
    count = Counter()
    for _, k, _, v, sign in rows:
        count[k, v] += sign
    return +count


@pytest.mark.parametrize("how, residual", [("inner", False), ("left", False), ("right", True), ("full", False), ("full", True)])
def test_join_like_batch(spark, changes, how, residual):
    left, right = changes(40), changes(30)
    match = (lambda a, b: a["v"] <= b["w"]) if residual else None
    with run.rocksdb_state(spark):
        a = run.replay(spark.createDataFrame(left, CHANGE), STEPS).drop("step")
        b = run.replay(spark.createDataFrame(right, CHANGE), STEPS).drop("step").withColumnRenamed("v", "w")
        log = run.append_table(retract.join(a, b, "k", "at", how, match))
    got = Counter()
    for r in log.collect():
        got[r["k"], r["v"], r["w"]] += 1 if r["op"] == "+" else -1
    assert all(n >= 0 for n in got.values())
    one, two, expected = left_over(left), left_over(right), Counter()
    fits = lambda v, w: not residual or v <= w
    for (k, v), n in one.items():
        partners = {w: m for (j, w), m in two.items() if j == k and fits(v, w)}
        for w, m in partners.items():
            expected[k, v, w] += n * m
        if not partners and how in ("left", "full"):
            expected[k, v, None] += n
    for (k, w), m in two.items():
        if how in ("right", "full") and not any(j == k and fits(v, w) for j, v in one):
            expected[k, None, w] += m
    assert +got == expected


def test_first_partner_retracts_padding(spark):
    left = spark.createDataFrame([(0, "a", 1, 7, 1)], CHANGE)
    right = spark.createDataFrame([(1, "a", 2, 9, 1), (2, "a", 3, 9, -1), (3, "a", 4, 1, -1)], CHANGE)
    out = []
    with run.rocksdb_state(spark):
        both = spark.createDataFrame([(s, k, at, v, sign, 0) for s, k, at, v, sign in left.collect()] + [(s, k, at, v, sign, 1) for s, k, at, v, sign in right.collect()], CHANGE + ", side int")
        stream = run.replay(both, STEPS)
        a = stream.where("side = 0").select("k", "at", "v", "sign")
        b = stream.where("side = 1").select("k", "at", F.col("v").alias("w"), "sign")
        log = run.batch_log(retract.join(a, b, "k", "at", "left"), "append")
    out = [(r["op"], r["v"], r["w"]) for r in log.orderBy("_batch", F.col("op").desc()).collect()]
    assert out == [("+", 7, None), ("-", 7, None), ("+", 7, 9), ("-", 7, 9), ("+", 7, None)]


def test_aggregate_like_batch(spark, changes):
    rows = changes(60)
    with run.rocksdb_state(spark):
        stream = run.replay(spark.createDataFrame(rows, CHANGE), STEPS)
        log = run.append_table(retract.aggregate(stream, "k", "v"))
    per = defaultdict(Counter)
    for (k, v), n in left_over(rows).items():
        per[k][v] += n
    expected = sorted((k, sum(c.values()), float(sum(v * n for v, n in c.items())), float(min(c)), float(max(c)), len(c)) for k, c in per.items())
    assert sorted(tuple(r) for r in keyed.consolidate(log).collect()) == expected


def test_aggregate_falls_to_nothing(spark):
    rows = [(0, "a", 1, 5, 1), (0, "a", 1, 8, 1), (1, "a", 2, 8, -1), (2, "a", 3, 5, -1), (3, "b", 4, 1, -1), (3, "a", 4, None, 1)]
    with run.rocksdb_state(spark):
        stream = run.replay(spark.createDataFrame(rows, CHANGE), STEPS)
        log = run.batch_log(retract.aggregate(stream, "k", "v"), "append")
    got = [(r["op"], r["n"], r["low"], r["high"]) for r in log.orderBy("_batch", F.col("op").desc()).collect()]
    assert got == [("+", 2, 5.0, 8.0), ("-", 2, 5.0, 8.0), ("+", 1, 5.0, 5.0), ("-", 1, 5.0, 5.0)]


def test_changelog_of_changelog(spark, changes):
    """Keys by their number of rows; both levels run in one streaming query."""
    rows = changes(60)
    with run.rocksdb_state(spark):
        first = retract.aggregate(run.replay(spark.createDataFrame(rows, CHANGE), STEPS), "k", "v")
        sizes = retract.signed(first).select(F.col("n").alias("size"), "high", "sign")
        log = run.append_table(retract.aggregate(sizes, "size", "high"))
    per = defaultdict(Counter)
    for (k, v), n in left_over(rows).items():
        per[k][v] += n
    expected = defaultdict(list)
    for c in per.values():
        expected[sum(c.values())].append(float(max(c)))
    assert {r["size"]: (r["n"], r["total"]) for r in keyed.consolidate(log).collect()} == {n: (len(v), sum(v)) for n, v in expected.items()}


VERSION_ROW = "step int, k string, ts timestamp, id bigint, kind string, v double"


def versions(spark, rows, steps, how="inner", checkpoint=None):
    import datetime as d

    base = d.datetime(2024, 1, 1)
    table = spark.createDataFrame([(s, k, base + d.timedelta(seconds=at), i, kind, v) for s, k, at, i, kind, v in rows], VERSION_ROW)
    stream, finish = run.ending(run.replay(table, steps), "ts")
    marked = stream.withWatermark("ts", "20 seconds")
    tagged = temporal.tagged(marked, "k", "ts", F.col("kind") == "probe", F.col("kind") == "version", "id", "v")
    with run.rocksdb_state(spark):
        return run.append_table(temporal.as_of_join(tagged, "k", "id", "v", how), checkpoint, finish)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("steps", [["true"], STEPS])
def test_as_of_in_one_batch_or_many(spark, how, steps):
    """Rows arrive up to 15 seconds late; some versions come after their probes."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        at = rng.randrange(60)
        arrives = min(at + rng.randrange(15), 59) // 15
        rows.append((arrives, rng.choice("ab"), at, i, rng.choice(["probe", "version", "other"]), float(i)))
    seen = set()
    rows = [r for r in rows if r[4] != "version" or not ((r[1], r[2]) in seen or seen.add((r[1], r[2])))]
    got = Counter((r["k"], r["id"], r["v"]) for r in versions(spark, rows, steps, how).collect())
    expected = Counter()
    for _, k, at, i, kind, _ in rows:
        if kind == "probe":
            past = [(a, v) for _, j, a, _, other, v in rows if other == "version" and j == k and a <= at]
            if past or how == "left":
                expected[k, i, max(past)[1] if past else None] += 1
    assert got == expected


def test_as_of_state_is_pruned(spark):
    """Of versions behind the watermark one stays."""
    rows = [(s, "a", 100 * s + i, i, "version", float(i)) for s in range(4) for i in range(50)]
    checkpoint = run.checkpoint_path(spark)
    assert versions(spark, rows, STEPS, checkpoint=checkpoint).count() == 0
    state = spark.read.format("statestore").option("stateVarName", "versions").load(checkpoint)
    assert state.count() == 1


def test_as_of_kinds(spark):
    with pytest.raises(ValueError):
        temporal.as_of_join(None, "k", how="full")
