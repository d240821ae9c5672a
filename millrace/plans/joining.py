"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from millrace.operators import aggregates, joins, sessions
from millrace.plans.registry import query

_PAIR = "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM"


def _customers_orders(t, how):
    customers = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    orders = t.orders.where("o_totalprice > 300000").select("o_custkey", "o_orderkey", "o_totalprice")
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), how)
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


_SIDES = """(SELECT * FROM customer WHERE c_acctbal > 0) c {} JOIN
            (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"""


@query("join_inner", f"{_PAIR} {_SIDES.format('INNER')}")
def join_inner(t):
    return _customers_orders(t, "inner")


@query("join_left", f"{_PAIR} {_SIDES.format('LEFT')}")
def join_left(t):
    return _customers_orders(t, "left")


@query("join_right", f"{_PAIR} {_SIDES.format('RIGHT')}")
def join_right(t):
    return _customers_orders(t, "right")


@query("join_full", f"{_PAIR} {_SIDES.format('FULL')}")
def join_full(t):
    return _customers_orders(t, "full")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi(t):
    rich = t.orders.where("o_totalprice > 450000")
    return t.customer.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "join_anti",
    """SELECT c_custkey, c_name FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
)
def join_anti(t):
    rich = t.orders.where("o_totalprice > 450000")
    return t.customer.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "join_residual",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders
       ON c_custkey = o_custkey AND o_totalprice > 40 * c_acctbal AND o_orderstatus = 'F'""",
)
def join_residual(t):
    """Outer equi-join with a non-equality residual."""
    match = (
        (F.col("c_custkey") == F.col("o_custkey"))
        & (F.col("o_totalprice") > 40 * F.col("c_acctbal"))
        & (F.col("o_orderstatus") == "F")
    )
    return t.customer.join(t.orders, match, "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "join_single_row",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)",
)
def join_single_row(t):
    usual = t.orders.agg(F.avg("o_totalprice"))
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return joins.scalar_filter(rows, usual, lambda value: F.col("o_totalprice") > 1.8 * value)


@query(
    "join_hints",
    """SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS customers FROM customer
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def join_hints(t):
    """Aggregate first, then broadcast sides whose size was counted."""
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = per_nation.join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = named.join(joins.small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select("n_name", "r_name", "customers")


@query(
    "join_skewed_keys",
    """SELECT o_orderstatus, p_brand, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def join_skewed_keys(t):
    """Salted joins on the fly; no key of these tables is hot (``join_hot_key`` has one)."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), "l_quantity")
    orders = t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    parts = t.part.select(F.col("p_partkey").alias("partkey"), "p_brand")
    both = joins.skew_join(joins.skew_join(lines, orders, ["orderkey"]), parts, ["partkey"], profile=lines)
    return both.groupBy("o_orderstatus", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "join_self",
    """SELECT a.l_orderkey, a.l_partkey AS part_a, b.l_partkey AS part_b, CAST(count(*) AS BIGINT) AS n
       FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
       WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' GROUP BY ALL""",
)
def join_self(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    a = lines.where("l_returnflag = 'R'").select(
        F.col("l_orderkey"), F.col("l_partkey").alias("part_a"), (F.col("l_linenumber") + 1).alias("line")
    )
    b = lines.where("l_returnflag = 'A'").select(
        F.col("l_orderkey"), F.col("l_partkey").alias("part_b"), F.col("l_linenumber").alias("line")
    )
    joined = a.join(b, ["l_orderkey", "line"])
    return joined.groupBy("l_orderkey", "part_a", "part_b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cogroup_counts",
    """SELECT coalesce(a.k, b.k) AS k, orders, total, bought, best FROM
       (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) a
       FULL JOIN (SELECT user_id AS k, CAST(count(*) AS BIGINT) AS bought, max(value) AS best FROM events
                  WHERE event_type = 'purchase' GROUP BY 1) b ON a.k = b.k""",
)
def cogroup_counts(t):
    left = t.orders.select(F.col("o_custkey").alias("k"), "o_totalprice")
    right = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "value")
    both = joins.cogroup(
        left,
        right,
        ["k"],
        {"orders": ("count", "*"), "total": ("sum", "o_totalprice")},
        {"bought": ("count", "*"), "best": ("max", "value")},
    )
    return both.withColumn("total", F.round("total", 2))


@udtf(returnType="word string, size int")
class Words:
    """Words of a text that have at least ``least`` letters; ``outer`` pads an empty result with nulls.

    The padding is done here because the outer form of a Python table function drops empty results.
    """

    def eval(self, text: str, least: int, outer: bool):
        found = [word for word in (text or "").lower().split(" ") if len(word) >= least]
        for word in found:
            yield word, len(word)
        if outer and not found:
            yield None, None


@query(
    "lateral_udtf",
    """SELECT conv_id, turn, word, CAST(length(word) AS INTEGER) AS size FROM
       (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE length(word) >= 12""",
)
def lateral_udtf(t):
    rows = t.conversations
    joined = rows.lateralJoin(Words(F.col("text").outer(), F.lit(12), F.lit(False)))
    return joined.select("conv_id", "turn", "word", "size")


@query(
    "lateral_udtf_outer",
    """SELECT c.conv_id, c.turn, w.word, w.size FROM conversations c LEFT JOIN
       (SELECT conv_id, turn, word, CAST(length(word) AS INTEGER) AS size FROM
        (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE length(word) >= 14) w
       ON c.conv_id = w.conv_id AND c.turn = w.turn""",
)
def lateral_udtf_outer(t):
    rows = t.conversations
    joined = rows.lateralJoin(Words(F.col("text").outer(), F.lit(14), F.lit(True)))
    return joined.select("conv_id", "turn", "word", "size")


@query(
    "unnest_array",
    """SELECT label, CAST(pos AS INTEGER) AS pos, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean FROM
       (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL""",
)
def unnest_array(t):
    items = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")
    return items.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), mean)


@query(
    "unnest_multiset",
    "SELECT l_returnflag, l_linenumber AS line FROM lineitem",
)
def unnest_multiset(t):
    """COLLECT into a multiset, then one row per occurrence again."""
    bags = aggregates.multiset(t.lineitem, ["l_returnflag"], "l_linenumber", "lines")
    return aggregates.unnest_multiset(bags, "lines", "line")


@query(
    "temporal_join_asof",
    """
    WITH probe AS (SELECT event_id, user_id AS k, TIMESTAMP '1995-01-01' + (ts - TIMESTAMP '2024-01-01') * 80 AS at FROM events),
         hist AS (SELECT o_custkey AS k, o_orderdate, o_orderkey, o_totalprice FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)
    SELECT event_id, probe.k, o_orderkey, o_totalprice FROM probe ASOF JOIN hist ON probe.k = hist.k AND probe.at >= hist.o_orderdate
    """,
)
def temporal_join_asof(t):
    """The last order of the customer at the (stretched) time of each event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    base = F.unix_micros(F.lit("1995-01-01").cast("timestamp"))
    probe = t.events.select(
        "event_id", F.col("user_id").alias("k"), F.timestamp_micros(base + micros * 80).cast("timestamp_ntz").alias("at")
    )
    history = t.orders.select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", "o_totalprice")
    joined = joins.temporal_join(probe, history, "k", "at", "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"])
    return joined.select("event_id", "k", "o_orderkey", "o_totalprice")


_CLICKS = "(SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click')"
_BUYS = "(SELECT event_id AS buy_id, user_id, ts AS buy_ts FROM events WHERE event_type = 'purchase')"


def _clicks_buys(t):
    clicks = t.events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    buys = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("buy_ts"))
    return clicks, buys


_BOUND = "c.user_id = b.user_id AND click_ts BETWEEN buy_ts - INTERVAL 4 HOUR AND buy_ts + INTERVAL 1 HOUR"


@query("interval_join_batch", f"SELECT click_id, buy_id, c.user_id FROM {_CLICKS} c JOIN {_BUYS} b ON {_BOUND}")
def interval_join_batch(t):
    clicks, buys = _clicks_buys(t)
    joined = joins.interval_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", 4 * 3600, 3600)
    return joined.select("click_id", "buy_id", "user_id")


@query(
    "interval_join_full",
    f"SELECT click_id, buy_id, coalesce(c.user_id, b.user_id) AS user_id FROM {_CLICKS} c FULL JOIN {_BUYS} b ON {_BOUND}",
)
def interval_join_full(t):
    clicks, buys = _clicks_buys(t)
    joined = joins.interval_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", 4 * 3600, 3600, "full")
    return joined.select("click_id", "buy_id", "user_id")


@query(
    "window_join_tumble",
    f"""SELECT click_id, buy_id, c.user_id, time_bucket(INTERVAL 6 HOUR, click_ts) AS window_start
        FROM {_CLICKS} c JOIN {_BUYS} b ON c.user_id = b.user_id
        AND time_bucket(INTERVAL 6 HOUR, click_ts) = time_bucket(INTERVAL 6 HOUR, buy_ts)""",
)
def window_join_tumble(t):
    clicks, buys = _clicks_buys(t)
    joined = joins.window_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", "6 hours")
    return joined.select("click_id", "buy_id", "user_id", "window_start")


@query(
    "window_join_slide",
    f"""WITH c AS (SELECT *, time_bucket(INTERVAL 3 HOUR, click_ts) - INTERVAL 3 HOUR * unnest([0, 1]) AS w FROM {_CLICKS}),
             b AS (SELECT *, time_bucket(INTERVAL 3 HOUR, buy_ts) - INTERVAL 3 HOUR * unnest([0, 1]) AS w FROM {_BUYS})
        SELECT click_id, buy_id, c.user_id, c.w AS window_start FROM c JOIN b ON c.user_id = b.user_id AND c.w = b.w""",
)
def window_join_slide(t):
    """Pairs in one sliding window; a pair is in as many windows as hold both."""
    clicks, buys = _clicks_buys(t)
    joined = joins.window_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", "6 hours", "3 hours")
    return joined.select("click_id", "buy_id", "user_id", "window_start")


@query(
    "window_join_session",
    """WITH u AS (SELECT event_id, event_type, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before
                  FROM events WHERE event_type IN ('click', 'purchase')),
            s AS (SELECT *, sum(CASE WHEN ts <= before + INTERVAL 2 HOUR THEN 0 ELSE 1 END)
                  OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM u)
       SELECT c.event_id AS click_id, b.event_id AS buy_id, c.user_id FROM s c JOIN s b ON c.user_id = b.user_id AND c.s = b.s
       WHERE c.event_type = 'click' AND b.event_type = 'purchase'""",
)
def window_join_session(t):
    """Pairs in one session of both streams."""
    clicks, buys = _clicks_buys(t)
    joined = sessions.session_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", 2 * 3600)
    return joined.select("click_id", "buy_id", "user_id")


_HOT = "CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_partkey END"


@query(
    "join_hot_key",
    f"""SELECT k, name, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM (SELECT {_HOT} AS k, l_quantity FROM lineitem)
        LEFT JOIN (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 0, 'common') USING (k) GROUP BY 1, 2""",
)
def join_hot_key(t):
    """A key with half of the rows: its left rows are salted, its right row repeated."""
    lines = t.lineitem.select(F.expr(_HOT).cast("bigint").alias("k"), "l_quantity")
    parts = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("bigint").alias("k"), F.col("p_name").alias("name"))
    common = t.spark.sql("SELECT 0L AS k, 'common' AS name")
    joined = joins.skew_join(lines, parts.unionByName(common), ["k"], "left")
    return joined.groupBy("k", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query(
    "join_flat",
    """SELECT o_orderkey, unnest(CASE WHEN l_quantity > 40 THEN [l_partkey, l_suppkey] WHEN l_quantity > 20 THEN [l_partkey] ELSE [] END) AS part
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def join_flat(t):
    """A function of the joined pair that gives none, one or several rows."""
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    parts = F.when(F.col("l_quantity") > 40, F.array("l_partkey", "l_suppkey")).when(F.col("l_quantity") > 20, F.array("l_partkey"))
    return joins.flat_join(t.orders, lines, ["o_orderkey"], parts, "part")


@query(
    "window_cogroup",
    """
    SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
           CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS clicks,
           CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS buys
    FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL
    """,
)
def window_cogroup(t):
    clicks, buys = _clicks_buys(t)
    left = clicks.withColumn("window_start", F.window("click_ts", "1 day").start)
    right = buys.withColumn("window_start", F.window("buy_ts", "1 day").start)
    both = joins.cogroup(left, right, ["user_id", "window_start"], {"clicks": ("count", "*")}, {"buys": ("count", "*")})
    return both.fillna(0, ["clicks", "buys"])
