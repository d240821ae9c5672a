"""Projection, predicates, subqueries, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import calc, ordered
from millrace.plans.registry import query


@query(
    "tpch_q3",
    """
    SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10
    """,
)
def tpch_q3(t):
    cut = F.lit("1998-03-15").cast("timestamp_ntz")
    customers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = t.orders.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_orderdate")
    lines = t.lineitem.where(F.col("l_shipdate") > cut).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")
    totals = joined.groupBy("l_orderkey", "o_orderdate").agg(revenue)
    return calc.limit_sorted(totals, [F.desc("revenue"), F.asc("l_orderkey")], 10)


@query(
    "tpch_q10",
    """
    SELECT c_custkey, c_name, n_name, c_acctbal, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE year(o_orderdate) > 1996 AND l_returnflag = 'R'
    GROUP BY c_custkey, c_name, n_name, c_acctbal ORDER BY revenue DESC, c_custkey LIMIT 20
    """,
)
def tpch_q10(t):
    orders = t.orders.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    lines = t.lineitem.where("l_returnflag = 'R'")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    spent = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(revenue)
    )
    named = (
        spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "n_name", "c_acctbal", F.round("revenue", 4).alias("revenue"))
    )
    return calc.limit_sorted(named, [F.desc("revenue"), F.asc("c_custkey")], 20)


@query(
    "calc_project_filter",
    """
    SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, upper(o_orderpriority) AS priority
    FROM orders WHERE o_totalprice > 250000 AND (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT o_custkey % 2 = 0
    """,
)
def calc_project_filter(t):
    kept = t.orders.where(
        (F.col("o_totalprice") > 250000) & F.col("o_orderstatus").isin("F", "O") & ~(F.col("o_custkey") % 2 == 0)
    )
    doubled = (F.col("o_totalprice") * 2).alias("doubled")
    return calc.project(kept, F.col("o_orderkey").alias("id"), doubled, F.upper("o_orderpriority").alias("priority"))


@query(
    "flat_map_tokens",
    """
    SELECT conv_id, turn, word, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM conversations)
    WHERE word <> '' GROUP BY ALL
    """,
)
def flat_map_tokens(t):
    words = t.conversations.select("conv_id", "turn", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return words.where("word <> ''").groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nested_field_access",
    """
    SELECT c_custkey, c_name AS who_name, c_nationkey AS who_nation, c_acctbal AS money_balance,
           c_mktsegment AS money_segment, c_acctbal > 0 AS positive FROM customer
    """,
)
def nested_field_access(t):
    nested = t.customer.select(
        "c_custkey",
        F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"),
        F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("money"),
    )
    read = nested.withColumn("positive", F.col("money.balance") > 0)
    return calc.flatten(calc.flatten(read, "who"), "money")


@query(
    "case_cast_logic",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier,
           CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS key_text,
           (NULLIF(o_orderstatus, 'F') = 'O') IS TRUE AS is_open, (NULLIF(o_orderstatus, 'F') = 'O') IS NULL AS is_unknown,
           o_totalprice BETWEEN 1000 AND 200000 AS between_ok, o_orderpriority LIKE '1-%' AS urgent,
           regexp_full_match(o_orderpriority, '(1|2)-(URGENT|HIGH)') AS similar
    FROM orders
    """,
)
def case_cast_logic(t):
    from millrace.functions.text import similar_to

    price = F.col("o_totalprice")
    is_open = F.nullif(F.col("o_orderstatus"), F.lit("F")) == "O"
    return t.orders.select(
        "o_orderkey",
        F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("tier"),
        price.cast("bigint").alias("whole"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        is_open.eqNullSafe(True).alias("is_open"),
        is_open.isNull().alias("is_unknown"),
        price.between(1000, 200000).alias("between_ok"),
        F.col("o_orderpriority").like("1-%").alias("urgent"),
        similar_to(F.col("o_orderpriority"), "(1|2)-(URGENT|HIGH)").alias("similar"),
    )


@query("in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list(t):
    kept = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3))
    return kept.select("c_custkey", "c_mktsegment")


@query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def in_subquery(t):
    rich = t.orders.where("o_totalprice > 400000").select("o_custkey")
    return t.customer.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(
    "not_in_subquery",
    """
    SELECT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL)
    """,
)
def not_in_subquery(t):
    return t.spark.sql(
        """SELECT c_custkey FROM {customer}
           WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL)""",
        customer=t.customer,
        orders=t.orders,
    )


@query(
    "exists_corr",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 10 * c_acctbal)",
)
def exists_corr(t):
    pending = t.orders.where("o_orderstatus = 'P'")
    match = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 10 * F.col("c_acctbal"))
    return t.customer.join(pending, match, "left_semi").select("c_custkey")


@query(
    "scalar_subquery",
    """
    SELECT o_orderkey, o_totalprice FROM orders o
    WHERE o_totalprice > 1.5 * (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
    """,
)
def scalar_subquery(t):
    usual = t.orders.groupBy(F.col("o_custkey").alias("who")).agg(F.avg("o_totalprice").alias("usual"))
    joined = t.orders.join(usual, F.col("o_custkey") == F.col("who"))
    return joined.where(F.col("o_totalprice") > 1.5 * F.col("usual")).select("o_orderkey", "o_totalprice")


@query(
    "sort_offset_fetch",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
)
def sort_offset_fetch(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    return calc.limit_sorted(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], fetch=25, offset=10)


@query(
    "first_n_grouped",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3
    """,
)
def first_n_grouped(t):
    top = calc.first_n(t.orders, 3, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return top.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "range_partition_sort",
    """
    SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx FROM orders
    """,
)
def range_partition_sort(t):
    """Range partition, sort inside partitions, and number rows across them."""
    return calc.zip_with_index(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query(
    "zip_with_unique_id",
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS distinct_ids FROM lineitem",
)
def zip_with_unique_id(t):
    ids = calc.zip_with_unique_id(t.lineitem.select("l_orderkey"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("distinct_ids"))


@query(
    "count_elements",
    "SELECT CAST(count(*) AS BIGINT) AS n FROM orders",
)
def count_elements(t):
    return calc.count_per_partition(t.orders).agg(F.sum("n").alias("n"))


@query(
    "sample_fixed_size",
    """
    SELECT CAST(least(500, count(*)) AS BIGINT) AS n, CAST(least(500, count(*)) AS BIGINT) AS distinct_rows,
           CAST(least(500, count(*)) AS BIGINT) AS known FROM orders
    """,
)
def sample_fixed_size(t):
    drawn = calc.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"], seed=7)
    known = drawn.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").select(
        F.col("o_orderkey").alias("known_key")
    )
    joined = drawn.join(known, F.col("o_orderkey") == F.col("known_key"), "left")
    return joined.agg(
        F.count("o_orderkey").alias("n"),
        F.count_distinct("o_orderkey").alias("distinct_rows"),
        F.count("known_key").alias("known"),
    )


@query(
    "sample_with_replacement",
    "SELECT CAST(40 AS BIGINT) AS n, CAST(40 AS BIGINT) AS draws FROM (SELECT 1)",
)
def sample_with_replacement(t):
    drawn = calc.sample_rows_with_replacement(t.orders.select("o_orderkey"), 40, ["o_orderkey"], seed=7)
    return drawn.agg(F.count("o_orderkey").alias("n"), F.count_distinct("draw").alias("draws"))


@query("sample_fraction")
def sample_fraction(t):
    return calc.sample_fraction(t.orders, 0.1, seed=3)


@query("sample_poisson")
def sample_poisson(t):
    return calc.sample_fraction(t.orders, 0.5, replace=True, seed=3)


@query(
    "custom_partition",
    """SELECT CAST((o_custkey * 31) % 16 AS INTEGER) AS partition, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY 1""",
)
def custom_partition(t):
    """Rows placed by a computed partition number: what each partition holds."""
    placed = calc.custom_partition(t.orders, F.col("o_custkey") * 31, 16).withColumn("partition", F.spark_partition_id())
    return placed.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def _keys(t):
    left = t.customer.select(F.col("c_nationkey").alias("k"))
    right = t.supplier.select(F.col("s_nationkey").alias("k"))
    return left, right


_LEFT = "SELECT c_nationkey AS k FROM customer"
_RIGHT = "SELECT s_nationkey AS k FROM supplier"


@query("union_all", f"{_LEFT} UNION ALL {_RIGHT}")
def union_all(t):
    left, right = _keys(t)
    return left.union(right)


@query("union_distinct", f"{_LEFT} UNION {_RIGHT}")
def union_distinct(t):
    left, right = _keys(t)
    return left.union(right).distinct()


@query("intersect", f"{_LEFT} INTERSECT {_RIGHT}")
def intersect(t):
    left, right = _keys(t)
    return left.intersect(right)


@query("intersect_all", f"{_LEFT} INTERSECT ALL {_RIGHT}")
def intersect_all(t):
    left, right = _keys(t)
    return left.intersectAll(right)


@query("except_distinct", f"{_LEFT} EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 12")
def except_distinct(t):
    left, right = _keys(t)
    return left.subtract(right.where("k > 12"))


@query("except_all", f"{_LEFT} EXCEPT ALL {_RIGHT}")
def except_all(t):
    left, right = _keys(t)
    return left.exceptAll(right)


@query(
    "dedup_by_stamp",
    """
    SELECT event_id, user_id, ts FROM (SELECT *, max(event_id) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
        SELECT event_id, user_id, ts FROM events
        UNION ALL SELECT event_id, user_id, ts + INTERVAL 1 HOUR FROM events WHERE event_type = 'click'))
    WHERE seen IS NULL OR event_id > seen
    """,
)
def dedup_by_stamp(t):
    """Replayed rows (clicks sent again an hour later) are dropped unless their stamp is new (P20)."""
    base = t.events.select("event_id", "user_id", "ts", "event_type")
    again = base.where("event_type = 'click'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    rows = base.union(again).select("event_id", "user_id", "ts")
    order = ["ts", "event_id"]
    earlier = ordered.running(rows, ["user_id"], order, {"seen": ("max", "event_id")}, exclusive=True)
    fresh = earlier.where(F.col("seen").isNull() | (F.col("event_id") > F.col("seen")))
    return fresh.select("event_id", "user_id", "ts")
