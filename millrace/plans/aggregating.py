"""Aggregation queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import aggregates, ordered
from millrace.plans.registry import query


@query(
    "agg_basic",
    """
    SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(l_linenumber, 3)) AS BIGINT) AS some,
           round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
           round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
           min(l_quantity) AS low, max(l_extendedprice) AS high
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
    """,
)
def agg_basic(t):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.nullif(F.col("l_linenumber"), F.lit(3))).alias("some"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.min("l_quantity").alias("low"),
        F.max("l_extendedprice").alias("high"),
    )


@query(
    "agg_global_empty",
    """SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS total, coalesce(sum(o_totalprice), 0) AS total0
       FROM orders WHERE o_totalprice < 0""",
)
def agg_global_empty(t):
    """A global aggregate gives one row even when nothing matches."""
    return t.orders.where("o_totalprice < 0").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_totalprice").alias("total"),
        aggregates.sum0("o_totalprice").alias("total0"),
    )


@query(
    "agg_sum0",
    """SELECT c_nationkey, round(coalesce(sum(CASE WHEN c_acctbal < -900 THEN c_acctbal END), 0), 2) AS debt,
              round(sum(CASE WHEN c_acctbal < -900 THEN c_acctbal END), 2) AS debt_or_null FROM customer GROUP BY 1""",
)
def agg_sum0(t):
    debt = F.when(F.col("c_acctbal") < -900, F.col("c_acctbal"))
    return t.customer.groupBy("c_nationkey").agg(
        F.round(aggregates.sum0(debt), 2).alias("debt"), F.round(F.sum(debt), 2).alias("debt_or_null")
    )


@query(
    "agg_avg_int_compat",
    """SELECT p_brand, CAST(sum(p_size) // count(p_size) AS INTEGER) AS avg_size,
              CAST(sum(p_partkey) // count(p_partkey) AS BIGINT) AS avg_key, round(avg(p_retailprice), 6) AS avg_price
       FROM part GROUP BY 1""",
)
def agg_avg_int_compat(t):
    return t.part.groupBy("p_brand").agg(
        aggregates.avg_keep_type("p_size", "int").alias("avg_size"),
        aggregates.avg_keep_type("p_partkey", "bigint").alias("avg_key"),
        F.round(aggregates.avg_keep_type("p_retailprice", "double"), 6).alias("avg_price"),
    )


@query(
    "agg_stddev_var",
    """SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd_samp,
              round(var_pop(l_quantity), 5) AS v_pop, round(var_samp(l_quantity), 5) AS v_samp FROM lineitem GROUP BY 1""",
)
def agg_stddev_var(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.stddev_pop("l_quantity"), 6).alias("sd_pop"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd_samp"),
        F.round(F.var_pop("l_quantity"), 5).alias("v_pop"),
        F.round(F.var_samp("l_quantity"), 5).alias("v_samp"),
    )


@query(
    "agg_distinct",
    """SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS line_sum,
              CAST(count(DISTINCT (l_partkey, l_suppkey)) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""",
)
def agg_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.sum_distinct("l_linenumber").alias("line_sum"),
        F.count_distinct("l_partkey", "l_suppkey").alias("pairs"),
        F.count(F.lit(1)).alias("n"),
    )


@query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "agg_collect_multiset",
    """SELECT l_returnflag, string_agg(l_linenumber || ':' || n, ',' ORDER BY l_linenumber) AS lines FROM
       (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""",
)
def agg_collect_multiset(t):
    bags = aggregates.multiset(t.lineitem, ["l_returnflag"], "l_linenumber", "bag")
    entries = F.array_sort(F.map_entries("bag"))
    shown = F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return bags.select("l_returnflag", F.array_join(shown, ",").alias("lines"))


@query(
    "agg_filter_having",
    """SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS done, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY 1 HAVING count(*) > 8 AND sum(o_totalprice) > 1000000""",
)
def agg_filter_having(t):
    totals = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )
    return totals.where("n > 8 AND total > 1000000").drop("n")


@query(
    "agg_minby_maxby",
    """SELECT user_id, arg_min(event_id, (value, event_id)) AS low_event, min(value) AS low,
              arg_max(event_id, (value, event_id)) AS high_event, max(value) AS high FROM events GROUP BY 1""",
)
def agg_minby_maxby(t):
    row, by = F.struct("event_id", "value"), F.struct("value", "event_id")
    ends = t.events.groupBy("user_id").agg(F.min_by(row, by).alias("lo"), F.max_by(row, by).alias("hi"))
    return ends.select(
        "user_id",
        F.col("lo.event_id").alias("low_event"),
        F.col("lo.value").alias("low"),
        F.col("hi.event_id").alias("high_event"),
        F.col("hi.value").alias("high"),
    )


@query(
    "agg_chained",
    """SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_quantity) AS least, max(l_tax) AS tax
       FROM lineitem GROUP BY 1""",
)
def agg_chained(t):
    """Several field aggregates on one grouping."""
    return t.lineitem.groupBy("l_suppkey").agg(
        F.sum("l_linenumber").alias("lines"), F.min("l_quantity").alias("least"), F.max("l_tax").alias("tax")
    )


def _larger(rows: pd.DataFrame) -> pd.DataFrame:
    """The reduce step: add the amounts, keep the greatest line number."""
    first = rows.iloc[[0]].copy()
    first["cents"] = rows["cents"].sum()
    first["top"] = rows["top"].max()
    return first


@query(
    "agg_reduce",
    """SELECT l_returnflag AS flag, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS cents,
              CAST(max(l_linenumber) AS BIGINT) AS top FROM lineitem GROUP BY 1""",
)
def agg_reduce(t):
    """A reduce function in Python, combined in every task before the shuffle."""
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("flag"),
        F.round(F.col("l_quantity") * 100).cast("bigint").alias("cents"),
        F.col("l_linenumber").cast("bigint").alias("top"),
    )
    return aggregates.reduce_groups(rows, ["flag"], _larger, "flag string, cents bigint, top bigint")


@query(
    "agg_combine",
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def agg_combine(t):
    """Partial results per task, without a shuffle, then merged."""
    partial = aggregates.combine_groups(
        t.orders.select("o_orderstatus", F.col("o_totalprice").alias("total")),
        ["o_orderstatus"],
        lambda g: pd.DataFrame({"o_orderstatus": [g["o_orderstatus"].iloc[0]], "total": [g["total"].sum()]}),
        "o_orderstatus string, total double",
    )
    return partial.groupBy("o_orderstatus").agg(F.round(F.sum("total"), 2).alias("total"))


@query(
    "agg_group_reduce_sorted",
    """SELECT user_id, CAST(count(*) FILTER (event_type <> before) AS BIGINT) AS changes, round(sum(value - was), 4) AS drift FROM
       (SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS was FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""",
)
def agg_group_reduce_sorted(t):
    """A sorted-group reduction: type changes and value drift in time order."""
    rows = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    pairs = ordered.previous(rows, ["user_id"], ["ts", "event_id"], {"before": "event_type", "was": "value"})
    return pairs.groupBy("user_id").agg(
        F.count_if(F.col("event_type") != F.col("before")).alias("changes"),
        F.round(F.sum(F.col("value") - F.col("was")), 4).alias("drift"),
    )


@query(
    "agg_rolling",
    """SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total,
              min(value) OVER w AS low, max(value) OVER w AS high FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def agg_rolling(t):
    """A result per record, as keyed stream aggregates emit."""
    rows = t.events.select("event_id", "user_id", "ts", "value")
    spec = {"n": ("count", "*"), "total": ("sum", "value"), "low": ("min", "value"), "high": ("max", "value")}
    out = ordered.running(rows, ["user_id"], ["ts", "event_id"], spec)
    return out.select("event_id", "user_id", "n", F.round("total", 4).alias("total"), "low", "high")


@query(
    "agg_fold_windows",
    """SELECT user_id, CAST(idx // 5 AS BIGINT) AS part, 'start-' || string_agg(event_type, '-' ORDER BY idx) AS folded FROM
       (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) GROUP BY ALL""",
)
def agg_fold_windows(t):
    """Fold with a start value over five records at a time."""
    rows = ordered.numbered(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    groups = rows.groupBy("user_id", F.expr("idx div 5").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "event_type"))).alias("items")
    )
    folded = F.aggregate("items", F.lit("start"), lambda acc, x: F.concat(acc, F.lit("-"), x["event_type"]))
    return groups.select("user_id", "part", folded.alias("folded"))


_SETS = "l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty"


def _measures():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")]


@query("grouping_sets", f"SELECT {_SETS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(t):
    return t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(*_measures())


@query("cube", f"SELECT {_SETS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(*_measures())


@query("rollup", f"SELECT {_SETS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(*_measures())


@query(
    "group_id_bits",
    """SELECT l_returnflag, l_linestatus, CAST(1 - grouping(l_returnflag) AS BIGINT) AS g_flag,
              CAST((1 - grouping(l_returnflag)) * 2 + (1 - grouping(l_linestatus)) AS BIGINT) AS g_bits,
              CAST((1 - grouping(l_returnflag)) + 2 * (1 - grouping(l_linestatus)) AS BIGINT) AS g_id,
              CAST(count(*) AS BIGINT) AS n
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def group_id_bits(t):
    names = ["l_returnflag", "l_linestatus"]
    return t.lineitem.cube(*names).agg(
        aggregates.grouping_bits(["l_returnflag"]).alias("g_flag"),
        aggregates.grouping_bits(names).alias("g_bits"),
        aggregates.group_id(names).alias("g_id"),
        F.count(F.lit(1)).alias("n"),
    )


_NUMBER = """SELECT '{0}' AS "column", CAST(count(*) AS BIGINT) AS total, CAST(count(*) - count({0}) AS BIGINT) AS nulls,
  CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infinites, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max,
  round(sum({0}), 3) AS sum, round(avg({0}), 3) AS mean, round(var_samp({0}), 3) AS variance, round(stddev_samp({0}), 3) AS stddev,
  CAST(NULL AS BIGINT) AS empty, CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length, CAST(NULL AS DOUBLE) AS mean_length,
  CAST(NULL AS BIGINT) AS trues, CAST(NULL AS BIGINT) AS falses FROM customer"""
_TEXT = """SELECT '{0}', count(*), count(*) - count({0}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  count(*) FILTER ({0} = ''), min(length({0})), max(length({0})), round(avg(length({0})), 3), NULL, NULL FROM customer"""
_FLAG = """SELECT 'rich', count(*), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  count(*) FILTER (c_acctbal > 5000), count(*) FILTER (NOT c_acctbal > 5000) FROM customer"""


@query(
    "summarize_columns",
    " UNION ALL ".join(
        [_NUMBER.format("c_custkey"), _NUMBER.format("c_acctbal"), _TEXT.format("c_name"), _TEXT.format("c_mktsegment"), _FLAG]
    ),
)
def summarize_columns(t):
    rows = t.customer.select(
        "c_custkey", "c_acctbal", "c_name", "c_mktsegment", (F.col("c_acctbal") > 5000).alias("rich")
    )
    out = aggregates.summarize(rows)
    for name in ("sum", "mean", "variance", "stddev", "mean_length"):
        out = out.withColumn(name, F.round(name, 3))
    return out


@query(
    "checksum",
    """SELECT CAST(count(*) AS BIGINT) AS n,
              CAST(sum(CAST('0x' || substr(md5(concat_ws('|', n_nationkey, n_name, n_regionkey, c_custkey)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum
       FROM nation JOIN customer ON c_nationkey = n_nationkey""",
)
def checksum(t):
    joined = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
    found = aggregates.checksum(joined.select("n_nationkey", "n_name", "n_regionkey", "c_custkey"))
    return found.withColumn("checksum", F.col("checksum").cast("bigint"))


@query(
    "histogram_accumulator",
    "SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
)
def histogram_accumulator(t):
    return t.orders.groupBy(F.floor(F.col("o_totalprice") / 10000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


class WeightedAverage(aggregates.UserAggregate):
    """Average of ``price`` weighted by ``weight``."""

    state = "total double, weight double"
    result = "double"

    def accumulate(self, rows):
        return {"total": (rows["price"] * rows["weight"]).sum(), "weight": rows["weight"].sum()}

    def merge(self, rows):
        return {"total": rows["total"].sum(), "weight": rows["weight"].sum()}

    def value(self, rows):
        return (rows["total"] / rows["weight"]).round(6)


@query(
    "udf_agg_weighted_avg",
    "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS price FROM lineitem GROUP BY 1",
)
def udf_agg_weighted_avg(t):
    rows = t.lineitem.select("l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("weight"))
    return aggregates.aggregate_user(rows, ["l_suppkey"], WeightedAverage(), "price")
