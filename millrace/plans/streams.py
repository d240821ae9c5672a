"""Structured Streaming queries; each runs its source to the end and returns the sink's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import calc
from millrace.patterns import stream as pattern_stream
from millrace.patterns.match import Pattern
from millrace.plans.registry import query
from millrace.streaming import eventtime, keyed, order, processors, retract, run, temporal


def _stream(t):
    return run.stream_table(t, "events", "ts")


def _plain_time(df, *columns):
    for name in columns:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


_MS = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"
_AGGS = "CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total"


def _totals():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


_ARRIVAL = "(ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END)"
_LATE_SQL = f"""
  WITH s AS (SELECT *, CASE WHEN {_ARRIVAL} < TIMESTAMP '2024-01-11' THEN 0 WHEN {_ARRIVAL} < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS step FROM events),
       m AS (SELECT a.step, max(b.ts) AS seen FROM (SELECT DISTINCT step FROM s) a LEFT JOIN s b ON b.step < a.step GROUP BY 1)"""


def _late_stream(t):
    wait = F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 5 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    rows = run.with_event_time(t.events.withColumn("arrival", F.col("ts") + wait), "ts")
    first = "arrival < TIMESTAMP_NTZ '2024-01-11'"
    second = "arrival >= TIMESTAMP_NTZ '2024-01-11' AND arrival < TIMESTAMP_NTZ '2024-01-21'"
    return run.replay(rows, [first, second, "arrival >= TIMESTAMP_NTZ '2024-01-21'"])


def _waiting(t):
    """(events over three micro-batches, a seventh of them five days late, under a watermark that waits for those; the end)."""
    stream, finish = run.ending(_late_stream(t), "ts")
    return stream.withWatermark("ts", "6 days"), finish


@query(
    "stream_tumble_append",
    f"""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
        {_AGGS} FROM events GROUP BY ALL""",
)
def stream_tumble_append(t):
    """Windows are emitted once the watermark has passed them; the end of the input closes the rest."""
    stream, finish = run.ending(_stream(t), "ts")
    windows = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours").alias("w"), "event_type")
    rows = windows.agg(*_totals()).select("event_type", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")
    return _plain_time(run.append_table(rows, finish=finish), "window_start", "window_end")


@query(
    "stream_tumble_update",
    f"SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, {_AGGS} FROM events GROUP BY ALL",
)
def stream_tumble_update(t):
    """Early results by update mode into an upsert table: open windows are there as well."""
    windows = _stream(t).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    rows = windows.agg(*_totals()).select("event_type", F.col("w.start").alias("window_start"), "n", "total")
    return _plain_time(run.upsert_table(rows, ["event_type", "window_start"]), "window_start")


@query(
    "stream_hop_complete",
    f"""SELECT event_type, window_start, {_AGGS} FROM
        (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * unnest([0, 1]) AS window_start FROM events) GROUP BY ALL""",
)
def stream_hop_complete(t):
    windows = _stream(t).groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type")
    rows = windows.agg(*_totals()).select("event_type", F.col("w.start").alias("window_start"), "n", "total")
    return _plain_time(run.complete_table(rows), "window_start")


@query(
    "stream_session",
    f"""SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, {_AGGS} FROM
        (SELECT *, sum(CASE WHEN ts <= before + INTERVAL 4 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
         (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s""",
)
def stream_session(t):
    stream, finish = run.ending(_stream(t), "ts")
    windows = stream.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id")
    rows = windows.agg(*_totals()).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")
    return _plain_time(run.append_table(rows, finish=finish), "window_start", "window_end")


@query("stream_dedup", "SELECT event_id, user_id, ts FROM events")
def stream_dedup(t):
    """Clicks are sent twice; copies within the watermark are dropped."""
    first = _stream(t)
    again = _stream(t).where("event_type = 'click'")
    rows = first.unionByName(again).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return _plain_time(run.append_table(rows.select("event_id", "user_id", "ts")), "ts")


@query(
    "stream_union_filter",
    """SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 100
       UNION ALL SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value < 50""",
)
def stream_union_filter(t):
    """Two streams with their own filters, in one (E5)."""
    a = _stream(t).where("event_type = 'click' AND value > 100").select("event_id", "user_id", "value")
    b = _stream(t).where("event_type = 'purchase' AND value < 50").select("event_id", "user_id", "value")
    return run.append_table(a.unionByName(b))


@query(
    "stream_side_outputs",
    """SELECT CASE WHEN value > 200 THEN 'high' ELSE 'rest' END AS tag, event_id, value FROM events
       UNION ALL SELECT 'error', event_id, value FROM events WHERE event_type = 'error'""",
)
def stream_side_outputs(t):
    """One pass, several tagged outputs."""
    tags = {"high": "value > 200", "rest": "NOT value > 200", "error": "event_type = 'error'"}
    parts = run.side_outputs(_stream(t).select("event_id", "event_type", "value"), tags)
    frames = [df.select(F.lit(tag).alias("tag"), "event_id", "value") for tag, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_CLICKS = "(SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click')"
_BUYS = "(SELECT event_id AS buy_id, user_id, ts AS buy_ts FROM events WHERE event_type = 'purchase')"


@query(
    "interval_join_stream",
    f"""SELECT click_id, buy_id, c.user_id FROM {_CLICKS} c JOIN {_BUYS} b
        ON c.user_id = b.user_id AND click_ts BETWEEN buy_ts - INTERVAL 4 HOUR AND buy_ts + INTERVAL 1 HOUR""",
)
def interval_join_stream(t):
    clicks = _stream(t).where("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts")).withWatermark("click_ts", "1 hour")
    buys = _stream(t).where("event_type = 'purchase'").select(
        F.col("event_id").alias("buy_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts")).withWatermark("buy_ts", "1 hour")
    match = F.expr(
        "user_id = buyer AND click_ts >= buy_ts - INTERVAL 4 HOURS AND click_ts <= buy_ts + INTERVAL 1 HOURS"
    )
    return run.append_table(clicks.join(buys, match).select("click_id", "buy_id", "user_id"))


@query(
    "stream_regular_join",
    """SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE o_totalprice > 400000 AND l_quantity > 40""",
)
def stream_regular_join(t):
    """Inner join of two unbounded streams; its state grows with the input."""
    orders = run.stream_table(t, "orders").where("o_totalprice > 400000").select("o_orderkey")
    lines = run.stream_table(t, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_partkey", "l_quantity")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return run.append_table(joined.select("o_orderkey", "l_partkey", "l_quantity"))


@query(
    "stream_static_join",
    """SELECT event_id, c_name, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'""",
)
def stream_static_join(t):
    rows = _stream(t).where("event_type = 'purchase'").select("event_id", "user_id")
    joined = rows.join(t.customer, F.col("user_id") == F.col("c_custkey"))
    return run.append_table(joined.select("event_id", "c_name", "c_mktsegment"))


@query(
    "stream_latest_version_join",
    """SELECT b.event_id, b.user_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') b
       ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts""",
)
def stream_latest_version_join(t):
    """Purchases with the latest view of the user, rows arriving in order of event time once the watermark has passed them."""
    stream, finish = _waiting(t)
    rows = stream.select("ts", "event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("at"))
    views = run.above_watermark(rows, "ts", F.col("event_type") == "view").select("ts", "user_id", "at", F.col("value").alias("seen"))
    buys = run.above_watermark(rows, "ts", F.col("event_type") == "purchase")
    with run.rocksdb_state(t.spark):
        return run.append_table(keyed.latest_version_join(buys, views, "user_id", "at", "event_id", "seen", "ts"), finish=finish)


_ROLL = """SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total,
           min(value) OVER w AS low, max(value) OVER w AS high FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


@query("stream_rolling", _ROLL)
def stream_rolling(t):
    """A rolling aggregate per record from keyed state, over several micro-batches."""
    stream = run.replay(run.with_event_time(t.events, "ts"), _STEPS)
    rows = stream.select("event_id", "user_id", F.unix_micros("ts").alias("at"), "value")
    out = keyed.rolling(rows, "user_id", ["at", "event_id"], "value", ["event_id"])
    return run.append_table(out).withColumn("total", F.round("total", 4))


@query(
    "stream_count_window",
    """SELECT user_id, CAST(idx // 4 AS BIGINT) AS "window", round(sum(value), 4) AS total FROM
       (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)
       GROUP BY user_id, idx // 4 HAVING count(*) = 4""",
)
def stream_count_window(t):
    """Every four events of a user, counted in order of event time over micro-batches that bring some of them late."""
    stream, finish = _waiting(t)
    rows = stream.select("ts", "event_id", "user_id", F.unix_micros("ts").alias("at"), "value")
    with run.rocksdb_state(t.spark):
        out = run.append_table(keyed.count_windows(rows, "user_id", ["at", "event_id"], "value", 4, "ts"), finish=finish)
    return out.withColumn("total", F.round("total", 4))


@query(
    "stream_connected_rules",
    """SELECT b.event_id, b.user_id, max(s.value) AS bar FROM events b JOIN events s ON s.user_id = b.user_id AND s.event_type = 'signup' AND s.ts < b.ts
       WHERE b.event_type = 'purchase' GROUP BY b.event_id, b.user_id, b.value HAVING b.value > max(s.value)""",
)
def stream_connected_rules(t):
    """Two connected streams sharing the state of a user: purchases above the highest bar set so far."""
    rows, finish = _waiting(t)
    bars = run.above_watermark(rows, "ts", F.col("event_type") == "signup").select("ts", "user_id", F.unix_micros("ts").alias("at"), "value")
    buys = run.above_watermark(rows, "ts", F.col("event_type") == "purchase").select("ts", "user_id", F.unix_micros("ts").alias("at"), "event_id", "value")
    joined = keyed.connect(bars, buys, "user_id", "at", "ts")

    def bar(state, row):
        return max(state or 0.0, row["value"])

    def check(state, row):
        return [(row["event_id"], state)] if state is not None and row["value"] > state else []

    with run.rocksdb_state(t.spark):
        return run.append_table(keyed.co_process(joined, "user_id", bar, check, "event_id bigint, bar double", "double", "ts"), finish=finish)


@query("trigger_delta_topspeed")
def trigger_delta_topspeed(t):
    """Fires when a user's value has moved by 100; best record of the last two days."""
    stream, finish = _waiting(t)
    rows = stream.select("ts", "event_id", "user_id", F.unix_micros("ts").alias("at"), "value")
    with run.rocksdb_state(t.spark):
        out = keyed.delta_windows(rows, "user_id", ["at", "event_id"], "at", "value", "value", 100.0, 2 * 86_400_000_000, "ts")
        return run.append_table(out, finish=finish)


_STEPS = ["day(ts) <= 10", "day(ts) > 10 AND day(ts) <= 20", "day(ts) > 20"]


def _signed(t):
    """Events as additions, and every error event taken back in the last step."""
    added = t.events.select("event_id", "user_id", "event_type", "ts", "value", F.lit(1).alias("sign"))
    taken = added.where("event_type = 'error'").withColumn("sign", F.lit(-1)).withColumn("ts", F.lit("2024-01-31").cast("timestamp_ntz"))
    return added.unionByName(taken)


@query(
    "stream_groupby_changelog",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events
       WHERE event_type <> 'error' GROUP BY 1""",
)
def stream_groupby_changelog(t):
    """A retracting group-by over three micro-batches, consolidated to the table it stands for."""
    cents = _signed(t).withColumn("value", F.col("value") * 1.0)
    log = run.append_table(keyed.changelog(run.replay(cents, _STEPS), "user_id", "value"))
    return keyed.consolidate(log).withColumn("total", F.round("total", 4))


@query(
    "retraction_nested",
    """SELECT n, CAST(count(*) AS BIGINT) AS users FROM
       (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) GROUP BY 1""",
)
def retraction_nested(t):
    """Counts of counts: the second level reads the retractions of the first."""
    log = run.append_table(keyed.changelog(run.replay(_signed(t), _STEPS), "user_id", "value"))
    second = log.groupBy("n").agg(F.sum(F.when(F.col("op") == "+", 1).otherwise(-1)).alias("users"))
    return second.where("users > 0")


def _changes(rows, at, first, taken):
    """A table as a changelog in three micro-batches: half of it, the rest, then the rows that ``taken`` takes back."""
    added = rows.withColumn("sign", F.lit(1)).withColumn("step", F.when(F.expr(first), 0).otherwise(1)).withColumn("at", F.lit(0))
    gone = rows.where(taken).withColumn("sign", F.lit(-1)).withColumn("step", F.lit(2)).withColumn("at", F.lit(1))
    return run.replay(added.unionByName(gone), ["step = 0", "step = 1", "step = 2"]).drop("step")


_KEPT_ORDERS = "(SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'P')"
_KEPT_LINES = "(SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 48 AND l_returnflag <> 'R')"
_JOINED = "SELECT o_orderkey, l_orderkey, o_totalprice, l_partkey, l_quantity"


def _join_changelog(t, how):
    """Large orders and large line items; pending orders and returned items are taken back at the end."""
    orders = t.orders.where("o_totalprice > 400000").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias("k"), "o_orderstatus")
    lines = t.lineitem.where("l_quantity > 48").select("l_orderkey", "l_partkey", "l_quantity", F.col("l_orderkey").alias("k"), "l_returnflag")
    left = _changes(orders, "at", "o_orderstatus = 'F'", "o_orderstatus = 'P'").drop("o_orderstatus")
    right = _changes(lines, "at", "l_returnflag <> 'N'", "l_returnflag = 'R'").drop("l_returnflag")
    with run.rocksdb_state(t.spark):
        log = run.append_table(retract.join(left, right, "k", "at", how))
    # a key may hold equal rows, so that rows are counted and not only kept
    net = log.groupBy(*[c for c in log.columns if c not in ("op", "k")]).agg(F.sum(F.when(F.col("op") == "+", 1).otherwise(-1)).alias("n"))
    left_over = net.where("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    return left_over.select("o_orderkey", "l_orderkey", "o_totalprice", "l_partkey", "l_quantity")


@query("stream_join_changelog", f"{_JOINED} FROM {_KEPT_ORDERS} JOIN {_KEPT_LINES} ON o_orderkey = l_orderkey")
def stream_join_changelog(t):
    """An unbounded inner join whose input is taken back in part."""
    return _join_changelog(t, "inner")


@query("stream_left_join_changelog", f"{_JOINED} FROM {_KEPT_ORDERS} LEFT JOIN {_KEPT_LINES} ON o_orderkey = l_orderkey")
def stream_left_join_changelog(t):
    """Orders without items stand padded until the first comes, and again when the last is taken back."""
    return _join_changelog(t, "left")


@query("stream_full_join_changelog", f"{_JOINED} FROM {_KEPT_ORDERS} FULL JOIN {_KEPT_LINES} ON o_orderkey = l_orderkey")
def stream_full_join_changelog(t):
    """Both sides padded."""
    return _join_changelog(t, "full")


def _aggregated(t):
    return retract.aggregate(run.replay(_signed(t), _STEPS), "user_id", "value")


@query(
    "stream_changelog_minmax",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high,
       round(avg(value), 8) AS mean FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def stream_changelog_minmax(t):
    """Least, greatest and mean under retractions: a bound that is taken back is sought among the values left."""
    with run.rocksdb_state(t.spark):
        table = keyed.consolidate(run.append_table(_aggregated(t)))
    return table.select("user_id", "n", F.round("total", 4).alias("total"), "low", "high", F.round(F.col("total") / F.col("n"), 8).alias("mean"))


@query(
    "stream_changelog_distinct",
    "SELECT user_id, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def stream_changelog_distinct(t):
    """Distinct values under retractions: a value counts until its last row is taken back."""
    with run.rocksdb_state(t.spark):
        table = keyed.consolidate(run.append_table(_aggregated(t)))
    return table.select("user_id", "distinct_values")


@query(
    "stream_changelog_nested",
    """SELECT n, CAST(count(*) AS BIGINT) AS users, max(high) AS high FROM
       (SELECT user_id, CAST(count(*) AS BIGINT) AS n, max(value) AS high FROM events WHERE event_type <> 'error' GROUP BY 1) GROUP BY 1""",
)
def stream_changelog_nested(t):
    """Users by their number of events: a streaming aggregate that consumes the changelog of another."""
    with run.rocksdb_state(t.spark):
        sizes = retract.signed(_aggregated(t)).select(F.col("n").alias("size"), "high", "sign")
        table = keyed.consolidate(run.append_table(retract.aggregate(sizes, "size", "high")))
    return table.select(F.col("size").alias("n"), F.col("n").alias("users"), "high")


@query(
    "stream_temporal_join",
    """SELECT b.event_id, b.user_id, v.value AS seen, v.ts AS seen_at FROM (SELECT * FROM events WHERE event_type = 'purchase') b
       ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts""",
)
def stream_temporal_join(t):
    """Purchases with the view of the user that was the latest at their own time; a seventh of the rows comes five days late."""
    stream, finish = run.ending(_late_stream(t), "ts")
    marked = stream.withWatermark("ts", "6 days")
    rows = temporal.tagged(marked, "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "view", "event_id", "value")
    with run.rocksdb_state(t.spark):
        joined = run.append_table(temporal.as_of_join(rows, "user_id", "event_id", "seen"), finish=finish)
    return joined.select("event_id", "user_id", "seen", F.timestamp_micros("version_at").cast("timestamp_ntz").alias("seen_at"))


@query(
    "stream_late_split",
    f"""{_LATE_SQL} SELECT event_id, coalesce(ts < seen - INTERVAL 1 DAY, false) AS late FROM s JOIN m USING (step)""",
)
def stream_late_split(t):
    """Late rows go to their own output."""
    good, late = order.split_late(_late_stream(t), "ts", 86_400)
    return good.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(
    "stream_sort",
    f"""{_LATE_SQL}, kept AS (SELECT s.* FROM s JOIN m USING (step) WHERE seen IS NULL OR ts > seen - INTERVAL 1 DAY)
        SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS place FROM kept""",
)
def stream_sort(t):
    """Event-time order across micro-batches; late rows are dropped."""
    rows = order.sort_stream(_late_stream(t).select("event_id", "ts"), "ts", 86_400)
    return calc.zip_with_index(rows, ["_batch", "ts", "event_id"], "place").select("event_id", "place")


@query(
    "stream_sort_arrivals",
    f"""{_LATE_SQL} SELECT event_id, CAST(row_number() OVER (ORDER BY step, value, event_id) - 1 AS BIGINT) AS place FROM s""",
)
def stream_sort_arrivals(t):
    """Processing-time order, rows of one time by value."""
    rows = order.sort_arrivals(_late_stream(t).select("event_id", "value"), ["value", "event_id"])
    return calc.zip_with_index(rows, ["_batch", "value", "event_id"], "place").select("event_id", "place")


_FRAME = "CAST(count(value) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS low, max(value) OVER w AS high, round(stddev_samp(value) OVER w, 6) AS deviation"


def _framed(t, **frame):
    rows, finish = _waiting(t)
    with run.rocksdb_state(t.spark):
        out = run.append_table(eventtime.over(rows.select("ts", "user_id", "event_id", "value"), "user_id", "ts", ["event_id"], "value", ["event_id"], **frame), finish=finish)
    return out.withColumn("total", F.round("total", 4)).withColumn("deviation", F.round("deviation", 6))


@query(
    "stream_over_rows",
    f"SELECT user_id, event_id, {_FRAME} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
def stream_over_rows(t):
    """The last four events of a user at each of them, in order of event time though some come late (O1-O3)."""
    return _framed(t, rows=3)


@query(
    "stream_over_range",
    f"SELECT user_id, event_id, {_FRAME} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)",
)
def stream_over_range(t):
    """The last two days of a user at each event (O1-O3)."""
    return _framed(t, micros=2 * 86_400_000_000)


def _panes_sql(pane, total, late="coalesce(w >= start + INTERVAL 1 DAY, false)"):
    """Firings of day windows: rows of one pane come out together; ``total`` says what a firing shows."""
    return f"""{_LATE_SQL}, r AS (SELECT event_type, value, step, time_bucket(INTERVAL 1 DAY, ts) AS start, seen - INTERVAL 1 DAY AS w FROM s JOIN m USING (step)),
        p AS (SELECT event_type, start, CASE WHEN {late} THEN step ELSE {pane} END AS pane, count(*) AS n, sum(value) AS total
              FROM r WHERE NOT coalesce(w >= start + INTERVAL 4 DAY, false) GROUP BY ALL)
        SELECT event_type, start AS window_start, CAST(row_number() OVER v - 1 AS INTEGER) AS firing, {total}
        FROM p WINDOW v AS (PARTITION BY event_type, start ORDER BY pane)"""


_GROWING = "CAST(sum(n) OVER v AS BIGINT) AS n, round(sum(total) OVER v, 4) AS total"


def _panes(t, **rules):
    stream, finish = run.ending(_late_stream(t).select("event_type", "ts", "value"), "ts")
    with run.rocksdb_state(t.spark):
        fired = run.append_table(eventtime.triggered(stream, "event_type", "ts", "value", 86_400, 86_400, 3 * 86_400, **rules), finish=finish)
    start = F.timestamp_millis("start").cast("timestamp_ntz")
    fired = fired.where(start < F.lit(run.END_OF_TIME).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY"))  # the end is no window
    return fired.select("event_type", start.alias("window_start"), "firing", "n", F.round("total", 4).alias("total"))


@query("stream_late_updates", _panes_sql("-1", _GROWING))
def stream_late_updates(t):
    """Day windows that fire again for rows up to three days late."""
    return _panes(t)


@query("stream_purging_trigger", _panes_sql("-1", "CAST(n AS BIGINT) AS n, round(total, 4) AS total"))
def stream_purging_trigger(t):
    """The same windows, emptied by each firing."""
    return _panes(t, purge=True)


@query("stream_processing_trigger", _panes_sql("step", _GROWING))
def stream_processing_trigger(t):
    """Windows that fire at each micro-batch, the tick of processing time, before their end as well."""
    return _panes(t, early=True)


@query(
    "stream_punctuated",
    f"""{_LATE_SQL}, k AS (SELECT a.step, max(b.ts) - INTERVAL 3 DAY AS mark FROM (SELECT DISTINCT step FROM s) a
          LEFT JOIN s b ON b.step < a.step AND b.event_type = 'signup' GROUP BY 1),
        kept AS (SELECT s.* FROM s JOIN k USING (step) WHERE ts >= coalesce(date_trunc('milliseconds', mark), ts)
                 AND ts < (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 3 DAY) FROM s WHERE event_type = 'signup'))
        SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS place FROM kept""",
)
def stream_punctuated(t):
    """Signups mark that all is there up to three days before them; rows up to the last mark come out, in order."""
    stream = eventtime.marked(_late_stream(t), F.when(F.col("event_type") == "signup", F.col("ts") - F.expr("INTERVAL 3 DAYS")))
    rows = stream.select("ts", "mark_at", "user_id", "event_id")

    def number(name, new, state):
        begun = state[0] if state else 0
        return new[["user_id", "event_id"]].assign(place=range(begun + 1, begun + len(new) + 1)), (begun + len(new),)

    with run.rocksdb_state(t.spark):
        return run.append_table(eventtime.in_order(rows, "user_id", "ts", ["event_id"], number, "user_id bigint, event_id bigint, place bigint", "n bigint"))


@query(
    "stream_rule_updates",
    """WITH c AS (SELECT event_id % 16 AS rule, ts, event_type, value, lead(ts) OVER (PARTITION BY event_id % 16 ORDER BY ts, event_id) AS until
                  FROM events WHERE event_type IN ('signup', 'error'))
       SELECT e.event_id, c.rule, c.value AS bar FROM events e JOIN c ON c.event_type = 'signup' AND c.ts <= e.ts AND (c.until IS NULL OR e.ts < c.until)
       WHERE e.event_type = 'purchase' AND e.value > c.value""",
)
def stream_rule_updates(t):
    """Signups set a rule, errors remove it; purchases are judged by the rules that are valid at their time."""
    stream, finish = _waiting(t)
    kind, copies = F.col("event_type"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rule = F.when(kind.isin("signup", "error"), F.col("event_id") % 16)
    found = eventtime.judged(stream, "ts", rule, F.when(kind == "signup", F.col("value")), kind == "purchase", "event_id", "value", copies)
    with run.rocksdb_state(t.spark):
        return run.append_table(found, finish=finish)


@query(
    "stream_idle_retention",
    """WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
            s AS (SELECT *, sum(CASE WHEN ts <= before + INTERVAL 12 HOUR THEN 0 ELSE 1 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS BIGINT) AS n FROM s""",
)
def stream_idle_retention(t):
    """A running count that is forgotten when its key is idle for twelve hours."""
    rows = _stream(t).withWatermark("ts", "0 seconds").select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at"))
    counted = keyed.counts_while_active(rows, "user_id", "at", ["event_id"], 12 * 3_600_000_000)
    return run.append_table(counted).select("event_id", "user_id", "n")


def _pattern_log(t, pattern):
    stream, end = run.ending(_stream(t).select("event_id", "user_id", "event_type", "ts"), "ts")
    found = pattern_stream.find(stream.withWatermark("ts", "1 hour"), "user_id", "ts", "event_id", pattern)
    return run.append_table(found, finish=end)


@query(
    "stream_pattern_within",
    """SELECT a.user_id, a.event_id AS a_id, arg_min(b.event_id, (b.ts, b.event_id)) AS b_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.event_type = 'purchase' WHERE a.event_type = 'click'
       GROUP BY a.user_id, a.event_id, a.ts HAVING min(b.ts) < a.ts + INTERVAL 6 HOUR""",
)
def stream_pattern_within(t):
    """Clicks followed by a purchase within six hours, found on the stream."""
    pattern = Pattern.begin("a", F.col("event_type") == "click").followed_by("b", F.col("event_type") == "purchase").within(6 * 3600)
    found = _pattern_log(t, pattern).where("kind = 'match'")
    return found.select("user_id", F.col("ids")[0].alias("a_id"), F.col("ids")[1].alias("b_id"))


@query(
    "stream_pattern_timeout",
    """SELECT user_id, event_id FROM events a WHERE event_type = 'signup'
       AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase'
                       AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts < a.ts + INTERVAL 1 DAY)""",
)
def stream_pattern_timeout(t):
    """Signups that see no purchase in a day, as the time-outs of a stream pattern."""
    pattern = Pattern.begin("a", F.col("event_type") == "signup").followed_by("b", F.col("event_type") == "purchase").within(86_400)
    return _pattern_log(t, pattern).where("kind = 'timeout'").select("user_id", F.col("ids")[0].alias("event_id"))


@query(
    "stream_pattern_strict",
    """SELECT user_id, a_id, b_id, c_id FROM (SELECT user_id, event_type, event_id AS a_id, lead(event_id) OVER w AS b_id, lead(event_type) OVER w AS b_type,
        lead(event_id, 2) OVER w AS c_id, lead(event_type, 2) OVER w AS c_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE event_type = 'view' AND b_type = 'click' AND c_type NOT IN ('error', 'click')""",
)
def stream_pattern_strict(t):
    """A view, then a click, then anything but an error or a click, row after row."""
    kind = F.col("event_type")
    pattern = Pattern.begin("a", kind == "view").next("b", kind == "click").not_next(kind == "error").next("c", kind != "click")
    found = _pattern_log(t, pattern)
    return found.select("user_id", *[F.col("ids")[i].alias(f"{n}_id") for i, n in enumerate("abc")])


@query(
    "stream_feedback",
    """SELECT event_id, CAST(greatest(0, floor(log2(value)) + 1) AS INTEGER) AS round,
              value / pow(2, greatest(0, floor(log2(value)) + 1)) AS value FROM events""",
)
def stream_feedback(t):
    """Values are halved until they drop below 1."""
    rows = _stream(t).select("event_id", "value")
    return order.feedback(rows, lambda df: df.withColumn("value", F.col("value") / 2), F.col("value") < 1)


@query(
    "stream_inactivity_timer",
    "SELECT user_id, CAST(count(*) AS BIGINT) AS n, epoch_us(max(ts)) // 1000 AS latest_ms FROM events GROUP BY 1",
)
def stream_inactivity_timer(t):
    """Users without a record for six hours, found by event-time timers."""
    stream, finish = run.ending(_stream(t).select("user_id", "ts"), "ts")
    rows = stream.withWatermark("ts", "0 seconds")
    with run.rocksdb_state(t.spark):
        return run.append_table(processors.inactivity(rows, "user_id", "ts", 6 * 3_600_000), finish=finish)


@query(
    "stream_state_ttl",
    "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL",
)
def stream_state_ttl(t):
    """Map state whose idle entries expire after an hour of processing time."""
    rows = _stream(t).select("user_id", "event_type")
    with run.rocksdb_state(t.spark, idle_batches=False):
        seen = run.append_table(processors.sightings(rows, "user_id", "event_type", 3_600_000))
    return seen.groupBy("user_id", "event_type").agg(F.max("n").alias("n"))


@query(
    "stream_state_read",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
)
def stream_state_read(t):
    """The state of a running count, read back from its checkpoint."""
    checkpoint = run.checkpoint_path(t.spark)
    run.batch_log(_stream(t).groupBy("event_type").count(), "update", checkpoint)
    state = t.spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.event_type").alias("event_type"), F.col("value.count").alias("n"))
