"""Streams: several micro-batches, lateness, outer joins and restart from a checkpoint."""

import pytest
from pyspark.sql import functions as F

from millrace.scratch import new_path
from millrace.streaming import keyed, order, run


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_changelog_retracts(spark):
    rows = table(spark, [(0, "bark", 1.0, 1), (1, "bark", 2.0, 1), (2, "oak", 5.0, 1), (3, "oak", 5.0, -1), (3, "elm", 1.0, -1)], "step int, word string, v double, sign int")
    log = run.append_table(keyed.changelog(run.replay(rows, [f"step = {i}" for i in range(4)]), "word", "v"))
    got = sorted((r["op"], r["word"], r["n"], r["total"]) for r in log.collect())
    assert got == [("+", "bark", 1, 1.0), ("+", "bark", 2, 3.0), ("+", "oak", 1, 5.0), ("-", "bark", 1, 1.0), ("-", "oak", 1, 5.0)]
    assert [tuple(r) for r in keyed.consolidate(log).collect()] == [("bark", 2, 3.0)]


def test_state_spans_batches_and_restart(spark):
    folder, checkpoint, out = new_path(spark, "in"), new_path(spark, "checkpoint"), []
    schema = "k string, at bigint, v double"
    for part in ([("a", 1, 1.0), ("a", 2, 2.0)], [("a", 3, 3.0), ("b", 4, 4.0)]):
        table(spark, part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        rolled = keyed.rolling(stream, "k", ["at"], "v", ["at"])
        run.each_batch(rolled, lambda batch, number: out.extend(tuple(r)[1:] for r in batch.collect()), checkpoint=checkpoint)
    assert sorted(out) == [(1, 1, 1.0, 1.0, 1.0), (2, 2, 3.0, 1.0, 2.0), (3, 3, 6.0, 1.0, 3.0), (4, 1, 4.0, 4.0, 4.0)]


def test_count_windows_wait(spark):
    rows = table(spark, [(s, "a", i, float(i)) for i, s in enumerate([0, 0, 1, 1, 1])], "step int, k string, at bigint, v double")
    out = run.append_table(keyed.count_windows(run.replay(rows, ["step = 0", "step = 1"]), "k", ["at"], "v", 3))
    assert [tuple(r) for r in out.collect()] == [("a", 0, 3.0)]


def test_delta_windows(spark):
    events = [(0, 10.0, 5.0), (1, 40.0, 9.0), (2, 70.0, 7.0), (3, 80.0, 8.0), (4, 130.0, 6.0)]
    rows = table(spark, [("car", at * 1_000_000, m, b, i % 2) for i, (at, m, b) in enumerate(events)], "k string, at bigint, m double, b double, s int")
    out = run.append_table(keyed.delta_windows(run.replay(rows, ["true"]), "k", ["at"], "at", "m", "b", 50.0, 2_000_000))
    got = sorted((r["fired_at"] // 1_000_000, r["best_at"] // 1_000_000, r["best"], r["held"]) for r in out.collect())
    assert got == [(2, 1, 9.0, 3), (4, 3, 8.0, 3)]


def test_latest_version_join_across_batches(spark):
    versions = table(spark, [(0, "e", 1, 1.0), (1, "e", 5, 2.0)], "step int, k string, at bigint, rate double")
    probes = table(spark, [(0, "e", 0, 10), (0, "e", 3, 11), (1, "e", 6, 12), (1, "y", 6, 13)], "step int, k string, at bigint, id bigint")
    steps = ["step = 0", "step = 1"]
    out = keyed.latest_version_join(run.replay(probes, steps), run.replay(versions, steps), "k", "at", "id", "rate")
    assert sorted((r["id"], r["rate"]) for r in run.append_table(out).collect()) == [(11, 1.0), (12, 2.0)]


@pytest.fixture
def late_stream(spark):
    rows = [(0, 10), (0, 20), (1, 5), (1, 16), (1, 40), (2, 29), (2, 31), (2, 50)]
    df = table(spark, rows, "step int, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    return run.replay(df, ["step = 0", "step = 1", "step = 2"])


def test_late_rows_go_aside(late_stream):
    good, late = order.split_late(late_stream, "ts", 10)
    assert sorted(r["at"] for r in late.collect()) == [5, 29]
    assert sorted(r["at"] for r in good.collect()) == [10, 16, 20, 31, 40, 50]


def test_stream_sort(late_stream):
    out = order.sort_stream(late_stream, "ts", 10).orderBy("_batch", "ts").collect()
    assert [r["at"] for r in out] == [10, 16, 20, 31, 40, 50]


def test_left_outer_stream_join(spark):
    a = table(spark, [(0, 1, 100), (0, 2, 105), (1, 9, 500)], "step int, k bigint, at bigint").withColumn("lt", F.timestamp_seconds("at"))
    b = table(spark, [(0, 1, 103), (1, 9, 500)], "step int, j bigint, at bigint").withColumn("rt", F.timestamp_seconds("at"))
    steps = ["step = 0", "step = 1"]
    left = run.replay(a, steps).select("k", "lt").withWatermark("lt", "0 seconds")
    right = run.replay(b, steps).select("j", "rt").withWatermark("rt", "0 seconds")
    on = F.expr("k = j AND rt >= lt AND rt <= lt + INTERVAL 10 SECONDS")
    out = run.append_table(left.join(right, on, "left").select("k", "j"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 1), (2, None), (9, 9)]


def test_feedback_stops_on_endless_loops(spark):
    stream = run.replay(table(spark, [(1.0,)], "v double"), ["true"])
    with pytest.raises(Exception, match="still circulate"):
        order.feedback(stream, lambda df: df, F.col("v") < 0, max_rounds=2)


def test_metrics_of_a_run(spark):
    stream = run.replay(table(spark, [(1,), (2,)], "v int"), ["true"])
    done = run.each_batch(stream.observe("seen", F.count(F.lit(1)).alias("n")), lambda batch, number: batch.count())
    assert sum(p["observedMetrics"]["seen"]["n"] for p in done.recentProgress if "seen" in p["observedMetrics"]) == 2


@pytest.mark.parametrize(
    "signs,want",
    [
        ([-1, 1, 1], (2, 5.0)),  # a retraction of what was never there is dropped
        ([1, -1, -1, 1], (1, 4.0)),
        ([1, 1, -1], (1, 0.0)),
        ([-1, -1], None),
        ([1, -1], None),
    ],
)
def test_changelog_in_one_batch(spark, signs, want):
    rows = [(i, "k", float(i + 1) if s > 0 or i == 0 else float(i), s) for i, s in enumerate(signs)]
    df = table(spark, rows, "at int, word string, v double, sign int").coalesce(1)
    path = new_path(spark, "one")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    log = run.append_table(keyed.changelog(stream, "word", "v", "at")).collect()
    held = total = 0
    for s, v in [(r[3], r[2]) for r in rows]:
        if s < 0 and not held:
            continue
        held, total = held + s, total + s * v
        total = total if held else 0
    assert [(r["op"], r["n"], r["total"]) for r in log] == ([("+", held, total)] if held else [])
    assert (held or None) == (want[0] if want else None)


def test_bounded_streams_give_all_windows(spark):
    rows = table(spark, [(0, 10), (0, 70), (1, 130), (1, 3600)], "step int, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    stream, finish = run.ending(run.replay(rows, ["step = 0", "step = 1"]), "ts")
    counts = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute").alias("w")).count()
    got = run.append_table(counts.select(F.unix_seconds("w.start").alias("s"), "count"), finish=finish)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (60, 1), (120, 1), (3600, 1)]


def test_patterns_span_batches(spark):
    from millrace.patterns import match, stream as pattern_stream
    from millrace.patterns.match import Pattern

    kinds = "abcaxbaabbcaxxb"
    rows = [(i * 7 % 3, 1, i, 1000 + i * 10, k) for i, k in enumerate(kinds)]  # batches that are out of order
    df = table(spark, rows, "step int, k int, id int, at int, kind string").withColumn("ts", F.timestamp_seconds("at"))
    is_ = lambda c: F.col("kind") == c
    patterns = [
        Pattern.begin("a", is_("a")).followed_by("b", is_("b")).within(35),
        Pattern.begin("a", is_("a")).next("b", is_("b")),
        Pattern.begin("a", is_("a")).not_followed_by(is_("x")).followed_by("b", is_("b")),
        Pattern.begin("a", is_("a")).not_next(is_("b")).followed_by("b", is_("b")),
    ]
    for pattern in patterns:
        stream, finish = run.ending(run.replay(df, [f"step = {i}" for i in range(3)]), "ts")
        found = pattern_stream.find(stream.withWatermark("ts", "10 minutes"), "k", "ts", "id", pattern)
        log = run.append_table(found, finish=finish).collect()
        got = sorted(tuple(r["ids"]) for r in log if r["kind"] == "match")
        batch = match.find(df, ["k"], ["ts", "id"], pattern, ["id"], "ts").collect()
        assert got == sorted((r["a"]["first"]["id"], r["b"]["last"]["id"]) for r in batch)
        if pattern.window:
            timed = sorted(r["ids"][0] for r in log if r["kind"] == "timeout")
            assert timed == [i for i, k in enumerate(kinds) if k == "a" and i not in {a for a, _ in got}]
    with pytest.raises(ValueError):
        pattern_stream.Steps(Pattern.begin("a", is_("a"), "+"))
