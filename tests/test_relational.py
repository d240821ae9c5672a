"""Joins, aggregates and rules on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import maths, nested, temporal, text
from millrace.operators import aggregates, calc, joins
from millrace.operators.calc import RuleError


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_temporal_join_answer(spark):
    orders = spark.createDataFrame([(2, "Euro", 2), (1, "US Dollar", 3), (50, "Yen", 4), (3, "Euro", 5)], "amount bigint, k string, at bigint")
    rates = spark.createDataFrame([("US Dollar", 102, 1), ("Euro", 114, 1), ("Yen", 1, 1), ("Euro", 116, 5), ("Euro", 119, 7)], "k string, rate bigint, since bigint")
    high = rates.where("rate > 110").withColumn("tie", F.lit(""))
    out = joins.temporal_join(orders, high, "k", "at", "since", "tie", ["rate"], slices=4)
    assert sorted(r["amount"] * r["rate"] for r in out.collect()) == [228, 348]
    left = joins.temporal_join(orders, high, "k", "at", "since", "tie", ["rate"], "left")
    assert left.count() == 4 and left.where("rate IS NULL").count() == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("a"))
    right = spark.range(30).select((F.col("id") % 15).alias("k"), F.col("id").alias("b"))
    got = rows_of(joins.skew_join(left, right, ["k"], how, share=0.1, salts=4))
    assert got == rows_of(left.join(right, ["k"], how))


def test_skew_join_repeats_only_the_right_side(spark):
    with pytest.raises(ValueError):
        joins.skew_join(spark.range(1), spark.range(1), ["id"], "right")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_interval_join(spark, how):
    left = spark.range(60).select((F.col("id") % 4).alias("k"), F.col("id").alias("a"), F.timestamp_seconds((F.col("id") * 37) % 200 - 100).alias("lt"))
    right = spark.range(50).select((F.col("id") % 5).alias("k"), F.col("id").alias("b"), F.timestamp_seconds((F.col("id") * 53) % 200 - 100).alias("rt"))
    got = joins.interval_join(left, right, ["k"], "lt", "rt", 7, 3, how)
    r = right.withColumnRenamed("k", "rk")
    on = (F.col("k") == F.col("rk")) & F.expr("lt >= rt - INTERVAL 7 SECONDS AND lt <= rt + INTERVAL 3 SECONDS")
    want = left.join(r, on, how)
    if how not in ("left_semi", "left_anti"):
        want = want.withColumn("k", F.coalesce("k", "rk")).select("k", "a", "lt", "b", "rt")
        got = got.select("k", "a", "lt", "b", "rt")
    assert rows_of(got) == rows_of(want)


def test_broadcast_only_when_small(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    big = joins.small(spark.range(100), 10)
    assert "broadcast" not in plan(spark.range(5).join(big, "id"))
    assert "broadcast" in plan(spark.range(5).join(joins.small(spark.range(100), 100), "id"))


def test_average_keeps_integer_type(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,), (4,), (5,), (None,)], "x int")
    assert df.agg(aggregates.avg_keep_type("x", "int").alias("m")).dtypes == [("m", "int")]
    assert df.agg(aggregates.avg_keep_type("x", "int")).first()[0] == 3
    low = spark.createDataFrame([(-1,), (-2,)], "x int")
    assert low.agg(aggregates.avg_keep_type("x", "int")).first()[0] == -1
    assert df.where("x > 9").agg(aggregates.avg_keep_type("x", "int")).first()[0] is None


def test_group_id(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b bigint, c int")
    sets = df.groupingSets([["b"], ["c"]], "b", "c").agg(aggregates.group_id(["b", "c"]).alias("g"))
    assert sorted(r["g"] for r in sets.collect()) == [1, 2]
    cube = df.cube("b", "c").agg(aggregates.group_id(["b", "c"]).alias("g"))
    assert sorted(r["g"] for r in cube.collect()) == [0, 1, 2, 3]


def test_multiset_round_trip(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", 3)], "k string, x int")
    bags = aggregates.multiset(df, ["k"], "x")
    assert {r["k"]: r["items"] for r in bags.collect()} == {"a": {1: 2, 2: 1}, "b": {3: 1}}
    assert rows_of(aggregates.unnest_multiset(bags, "items", "x")) == rows_of(df.where("x IS NOT NULL"))


def test_limit_needs_order(spark):
    with pytest.raises(RuleError):
        calc.limit_sorted(spark.range(3), [], 1)
    with pytest.raises(RuleError):
        calc.limit_sorted(spark.range(3), [F.col("id")], -1)
    assert [r[0] for r in calc.limit_sorted(spark.range(9), [F.desc("id")], 2, 3).collect()] == [5, 4]


def test_name_rules(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(RuleError):
        calc.project(df, F.col("a"), F.col("b").alias("A"))
    for names in (("x", "x"), ("x",), ("*", "y")):
        with pytest.raises(RuleError):
            calc.rename(df, *names)


def test_samples(spark):
    rows = spark.range(500)
    drawn = calc.sample_rows(rows, 40, ["id"], 3)
    assert drawn.distinct().count() == 40
    assert rows_of(drawn) == rows_of(calc.sample_rows(rows.repartition(9), 40, ["id"], 3))
    again = calc.sample_rows_with_replacement(rows, 1000, ["id"], 3)
    assert again.count() == 1000 and 300 < again.select("id").distinct().count() < 500
    parts = calc.split_exactly(rows, [0.7, 0.2, 0.1], ["id"])
    assert [p.count() for p in parts] == [350, 100, 50]
    assert parts[0].union(parts[1]).union(parts[2]).distinct().count() == 500


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        (lambda: maths.truncate(F.lit(0.29), 2), 0.29),
        (lambda: maths.truncate(F.lit(-1.999), 1), -1.9),
        (lambda: maths.divide_whole(F.lit(-7), F.lit(2)), -3),
        (lambda: temporal.date_format(F.lit("1990-01-02 03:04:05.678").cast("timestamp_ntz"), "%m/%d/%Y %H:%i:%s.%f"), "01/02/1990 03:04:05.678000"),
        (lambda: temporal.date_format(F.lit("1990-01-02 03:04:05").cast("timestamp_ntz"), "100%% %k %q"), "100% 3 q"),
        (lambda: temporal.date_format(F.lit("1990-01-02").cast("timestamp_ntz"), F.lit("%m/%d/%Y 5%%")), "01/02/1990 5%"),
        (lambda: temporal.timestamp_diff("MONTH", F.lit("2020-01-31").cast("timestamp_ntz"), F.lit("2020-02-29").cast("timestamp_ntz")), 0),
        (lambda: temporal.timestamp_diff("DAY", F.lit("2020-01-02").cast("timestamp_ntz"), F.lit("2020-01-01 12:00:00").cast("timestamp_ntz")), 0),
        (lambda: temporal.extract("CENTURY", F.lit("2000-06-01").cast("timestamp_ntz")), 20),
        (lambda: temporal.extract("MILLENNIUM", F.lit("2001-06-01").cast("timestamp_ntz")), 3),
        (lambda: text.similar_to(F.lit("a.c"), "a.c"), True),
        (lambda: text.similar_to(F.lit("abc"), "a.c"), False),
        (lambda: text.similar_to(F.lit("TE_ST"), "%(E\\_S|X)%", "\\"), True),
        (lambda: text.initcap(F.lit("hELLO wORLD-x 9y")), "Hello World-X 9y"),
        (lambda: nested.at(F.array(F.lit(1), F.lit(2)), 2), 2),
        (lambda: nested.at(F.array(F.lit(1)), 3), None),
        (lambda: nested.cardinality(F.lit(None).cast("array<int>")), None),
        (lambda: nested.element(F.array().cast("array<int>")), None),
        (lambda: nested.element(F.array(F.lit(7))), 7),
        (lambda: nested.lookup(F.create_map(F.lit("a"), F.lit(1)), "b"), None),
    ],
)
def test_function(spark, expression, expected):
    assert spark.range(1).select(expression()).first()[0] == expected


@pytest.mark.parametrize(
    "expression",
    [
        lambda: maths.strict_log(F.lit(-1.0)),
        lambda: maths.strict_log(F.lit(8.0), F.lit(1.0)),
        lambda: nested.element(F.array(F.lit(1), F.lit(2))),
        lambda: temporal.date_format(F.current_timestamp(), F.lit("%U")),
    ],
)
def test_function_refuses(spark, expression):
    with pytest.raises(Exception):
        spark.range(1).select(expression()).collect()


def test_constant_rules():
    with pytest.raises(ValueError):
        maths.sha2_checked(F, 0)
    with pytest.raises(ValueError):
        temporal.date_format(None, "%w")


def test_user_aggregate_is_called_once_a_key(spark, monkeypatch):
    """Rows meet by key first, whatever the batches; a hot key is cut into parts and merged, null keys and weights included."""
    from millrace.operators import aggregates
    from millrace.plans.aggregating import WeightedAverage

    class Counted(WeightedAverage):
        state = "total double, weight double, calls bigint"

        def accumulate(self, rows):
            return {**super().accumulate(rows), "calls": 1}

        def merge(self, rows):
            return {**super().merge(rows), "calls": rows["calls"].sum()}

        def value(self, rows):
            return rows["calls"].astype(float)

    rows = spark.range(0, 3000, 1, 6).selectExpr("IF(id % 10 = 0, NULL, id % 10) AS k", "double(id) AS price", "IF(id % 7 = 0, NULL, double(2)) AS weight")
    assert {r["calls"] for r in aggregates.aggregate_user(rows, ["k"], Counted(), "calls").collect()} == {1.0}
    monkeypatch.setattr(aggregates, "HOT", 100)
    got = {r["k"]: r["price"] for r in aggregates.aggregate_user(rows, ["k"], WeightedAverage(), "price").collect()}
    assert {r["calls"] for r in aggregates.aggregate_user(rows, ["k"], Counted(), "calls").collect()} == {3.0}
    want = {r["k"]: r["price"] for r in rows.groupBy("k").agg(F.expr("round(sum(price * weight) / sum(weight), 6) AS price")).collect()}
    assert got == want and None in got
