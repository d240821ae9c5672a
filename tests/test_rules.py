"""Rules that hold beyond the given tables: loops that end or raise, wide sums, ties, trailing conditions."""

import pytest
from pyspark.sql import functions as F

from millrace import iterate, scratch
from millrace.graph import local, loops
from millrace.graph.frame import Graph
from millrace.ml import neighbours
from millrace.operators import aggregates, calc, joins
from millrace.patterns import match
from millrace.patterns.match import Pattern


def chain(spark, n):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, value double")
    return Graph.from_edges(edges)


def test_loops_raise_when_cut_short(spark):
    graph = chain(spark, 6)
    with pytest.raises(RuntimeError):
        loops.connected_components(graph, max_rounds=1)
    with pytest.raises(RuntimeError):
        loops.shortest_paths(graph, F.lit(0), max_rounds=2)
    with pytest.raises(RuntimeError):
        loops.transitive_closure(graph.edges, max_rounds=2)
    with pytest.raises(ValueError):
        iterate.bulk_iterate(spark.range(1), lambda s, i: s, None)
    far = {r["id"]: r["value"] for r in loops.shortest_paths(graph, F.lit(0)).collect()}
    assert far == {i: float(i) for i in range(7)}
    assert loops.transitive_closure(graph.edges).count() == 21


def test_rounds_leave_one_table(spark):
    state, turns = iterate.bulk_iterate(spark.range(3), lambda s, i: s.select((F.col("id") + 1).alias("id")), 4)
    files, named = scratch._file_system(spark, state.inputFiles()[0].rsplit("/", 2)[0])
    tables = [f.getPath().getName() for f in files.listStatus(named) if f.getPath().getName().startswith("bulk-")]
    assert turns == 4 and sorted(r["id"] for r in state.collect()) == [4, 5, 6]
    assert len([t for t in tables if t in state.inputFiles()[0]]) == 1
    scratch.drop(spark.range(1))  # not a written table: nothing happens


def test_census_of_many_vertices(spark):
    n = 5_000_000
    graph = Graph(
        spark.range(n).withColumn("value", F.lit(None).cast("double")),
        spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, value double"),
    )
    got = local.triadic_census(graph).first()
    every = n * (n - 1) * (n - 2) // 6
    assert [int(v) for v in got] == [every - 1 - 2 * (n - 2) + 2, 2 * (n - 2) - 2, 1, 0]


def test_sums_beyond_a_bigint(spark):
    top = 2**63 - 1
    rows = spark.createDataFrame([(1, top), (1, top), (2, -top), (2, -top + 1), (3, None)], "k int, v long")
    got = rows.groupBy("k").agg(aggregates.avg_keep_type("v", "bigint").alias("a"))
    assert {r["k"]: r["a"] for r in got.collect()} == {1: top, 2: -top + 1, 3: None}


def test_repeated_elements_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "REPEATS", 7)
    bags = spark.sql("SELECT 1 AS k, map('a', 20L, 'b', 7L, 'c', 1L) AS bag UNION ALL SELECT 2, map() UNION ALL SELECT 3, NULL")
    got = aggregates.unnest_multiset(bags, "bag", "e").groupBy("k", "e").count().collect()
    assert {(r["k"], r["e"]): r["count"] for r in got} == {(1, "a"): 20, (1, "b"): 7, (1, "c"): 1}


def test_version_ties_keep_their_type(spark):
    left = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-02' AS at")
    versions = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01' AS since, id AS tie, concat('v', id) AS name FROM VALUES (9), (10) AS t(id)")
    got = joins.temporal_join(left, versions, "k", "at", "since", "tie", ["name"])
    assert [r["name"] for r in got.collect()] == ["v10"]


def test_numbers_are_partitions(spark):
    placed = calc.custom_partition(spark.range(64), F.col("id"), 8).withColumn("p", F.spark_partition_id())
    assert all(r["id"] % 8 == r["p"] for r in placed.collect())


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vector array<float>")
    assert neighbours.knn_join(some, none).count() == 0
    assert neighbours.knn_join(none, some).count() == 0


def events(spark, kinds, step=10):
    rows = [(1, i, i * step, kind) for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "k int, id int, at int, kind string").withColumn("ts", F.timestamp_seconds("at"))


def found(df, pattern, first, last):
    got = match.find(df, ["k"], ["ts", "id"], pattern, ["id"], "ts")
    return sorted((r[first]["first"]["id"], r[last]["last"]["id"]) for r in got.collect())


def test_trailing_not_next(spark):
    a, b = F.col("kind") == "a", F.col("kind") == "b"
    df = events(spark, "abacaa")
    assert found(df, Pattern.begin("a", a).not_next(b), "a", "a") == [(2, 2), (4, 4), (5, 5)]
    assert found(df, Pattern.begin("x", b | (F.col("kind") == "c")).next("a", a).not_next(a), "x", "a") == [(1, 2)]
    with pytest.raises(ValueError):
        found(df, Pattern.begin("a", a).not_followed_by(b), "a", "a")


def test_greedy_run_inside_a_time_limit(spark):
    a, b = F.col("kind") == "a", F.col("kind") == "b"
    run = Pattern.begin("a", a, "+").within(25)
    assert found(events(spark, "aaaa"), run, "a", "a") == [(0, 2), (1, 3), (2, 3), (3, 3)]
    closed = Pattern.begin("a", a, "+").next("b", b).within(25)
    assert found(events(spark, "aaab"), closed, "a", "b") == [(1, 3), (2, 3)]
    later = Pattern.begin("a", a, "+").followed_by("b", b).within(35)
    assert found(events(spark, "aaxb"), later, "a", "b") == [(0, 3), (1, 3)]
    with pytest.raises(ValueError):
        found(events(spark, "ab"), Pattern.begin("a", a).next("b", b, "+").within(5), "a", "b")


def test_unicode_literals():
    from millrace.functions import text

    for bad in ("\\00g1", "\\", "\\+0001", "\\+110000", "\\d800"):
        with pytest.raises(ValueError):
            text.unicode_literal(bad)
    for escape in ("a", "+", "'", " ", "\\\\"):
        with pytest.raises(ValueError):
            text.unicode_literal("x", escape)


def test_bucketed_side_is_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = scratch.bucketed(spark.range(1000).select((F.col("id") % 37).alias("src"), F.col("id").alias("dst")), "src", "edges")
        joined = edges.join(spark.range(37).select(F.col("id").alias("src"), F.lit(1).alias("v")), "src")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 1000
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("millrace_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
