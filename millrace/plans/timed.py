"""Group windows and over windows on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ordered, sessions, windows
from millrace.plans.registry import query

SPEC = {"n": ("count", "*"), "total": ("sum", "value"), "low": ("min", "value"), "high": ("max", "value")}
_AGGS = "CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high"


def _rounded(df):
    return df.withColumn("total", F.round("total", 4))


def _events(t):
    return t.events.select("event_id", "user_id", "event_type", "ts", "value")


@query(
    "tumble_time",
    f"""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
        {_AGGS} FROM events GROUP BY ALL""",
)
def tumble_time(t):
    return _rounded(windows.tumble(_events(t), ["event_type"], "ts", "1 hour", SPEC))


@query(
    "tumble_offset",
    f"""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS window_start,
        time_bucket(INTERVAL 1 DAY, ts - INTERVAL 5 HOUR) + INTERVAL 29 HOUR AS window_end, {_AGGS} FROM events GROUP BY ALL""",
)
def tumble_offset(t):
    return _rounded(windows.tumble(_events(t), ["event_type"], "ts", "1 day", SPEC, offset="5 hours"))


@query(
    "hop_time",
    f"""SELECT user_id, window_start, window_start + INTERVAL 4 HOUR AS window_end, {_AGGS} FROM
        (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * unnest([0, 1, 2, 3]) AS window_start FROM events) GROUP BY ALL""",
)
def hop_time(t):
    return _rounded(windows.hop(_events(t), ["user_id"], "ts", 3600, 4 * 3600, SPEC))


@query(
    "hop_uneven",
    f"""SELECT event_type, window_start, window_start + INTERVAL 150 MINUTE AS window_end, {_AGGS} FROM
        (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * unnest([0, 1, 2]) AS window_start FROM events)
        WHERE ts < window_start + INTERVAL 150 MINUTE GROUP BY ALL""",
)
def hop_uneven(t):
    """The size is not a multiple of the slide."""
    return _rounded(windows.hop(_events(t), ["event_type"], "ts", 3600, 9000, SPEC))


@query(
    "tumble_all",
    f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS window_end, {_AGGS} FROM events GROUP BY ALL",
)
def tumble_all(t):
    """A window over all keys; partial aggregates keep it off a single task."""
    return _rounded(windows.tumble(_events(t), [], "ts", "30 minutes", SPEC))


def _session_sql(gap):
    return f"""
    SELECT user_id, min(ts) AS window_start, max(till) AS window_end, {_AGGS} FROM
      (SELECT *, sum(CASE WHEN ts <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT *, max(till) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
         FROM (SELECT *, ts + {gap} AS till FROM events))) GROUP BY user_id, s"""


@query("session_gap", _session_sql("INTERVAL 3 HOUR"))
def session_gap(t):
    return _rounded(sessions.sessions(_events(t), ["user_id"], "ts", ["ts", "event_id"], 3 * 3600, SPEC))


@query("session_dynamic_gap", _session_sql("INTERVAL 1 HOUR * (event_id % 5 + 1)"))
def session_dynamic_gap(t):
    gap = (F.col("event_id") % 5 + 1) * 3600
    return _rounded(sessions.sessions(_events(t), ["user_id"], "ts", ["ts", "event_id"], gap, SPEC))


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"


@query(
    "tumble_count",
    f"SELECT user_id, CAST(idx // 4 AS BIGINT) AS \"window\", {_AGGS} FROM {_NUMBERED} GROUP BY user_id, idx // 4 HAVING count(*) = 4",
)
def tumble_count(t):
    return _rounded(windows.tumble_rows(_events(t), ["user_id"], ["ts", "event_id"], 4, SPEC))


@query(
    "slide_count",
    f"""SELECT user_id, CAST(idx // 2 AS BIGINT) AS "window", n, round(total, 4) AS total, low, high FROM
        (SELECT user_id, idx, CAST(count(*) OVER w AS BIGINT) AS n, sum(value) OVER w AS total, min(value) OVER w AS low, max(value) OVER w AS high
         FROM {_NUMBERED} WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS 4 PRECEDING)) WHERE (idx + 1) % 2 = 0""",
)
def slide_count(t):
    return _rounded(windows.slide_rows(_events(t), ["user_id"], ["ts", "event_id"], 5, 2, SPEC))


@query(
    "window_props",
    """SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS window_rowtime,
       round(stddev_samp(value), 6) AS spread, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY ALL""",
)
def window_props(t):
    grouped = t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(
        F.round(F.stddev_samp("value"), 6).alias("spread"), F.count_distinct("user_id").alias("users")
    )
    end = F.col("w.end")
    return grouped.select(
        "event_type",
        F.col("w.start").alias("window_start"),
        end.alias("window_end"),
        windows.window_rowtime(end).alias("window_rowtime"),
        "spread",
        "users",
    )


_DAY = "time_bucket(INTERVAL 1 DAY, ts)"


def _daily(t):
    return _events(t).withColumn("day", F.window("ts", "1 day").start)


def _per_day(df):
    return df.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "evict_count",
    f"""SELECT user_id, day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM
        (SELECT user_id, {_DAY} AS day, value FROM events
         QUALIFY row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts DESC, event_id DESC) <= 2) GROUP BY ALL""",
)
def evict_count(t):
    kept = windows.keep_last_rows(_daily(t), ["user_id", "day"], [F.desc("ts"), F.desc("event_id")], 2)
    return _per_day(kept)


@query(
    "evict_time",
    f"""SELECT user_id, day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM
        (SELECT user_id, {_DAY} AS day, value FROM events
         QUALIFY ts >= max(ts) OVER (PARTITION BY user_id, {_DAY}) - INTERVAL 2 HOUR) GROUP BY ALL""",
)
def evict_time(t):
    return _per_day(windows.keep_recent(_daily(t), ["user_id", "day"], "ts", 7200))


@query(
    "evict_delta",
    f"""SELECT user_id, day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM
        (SELECT user_id, {_DAY} AS day, value FROM events
         QUALIFY abs(last_value(value) OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - value) < 20) GROUP BY ALL""",
)
def evict_delta(t):
    return _per_day(windows.keep_near_last(_daily(t), ["user_id", "day"], ["ts", "event_id"], "value", 20.0))


@query(
    "trigger_continuous",
    """WITH panes AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) AS pane, value FROM events)
       SELECT user_id, window_start, fired_at, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM
       (SELECT *, unnest(generate_series(pane + INTERVAL 6 HOUR, window_start + INTERVAL 1 DAY, INTERVAL 6 HOUR)) AS fired_at FROM panes) GROUP BY ALL""",
)
def trigger_continuous(t):
    spec = {"n": ("count", "*"), "total": ("sum", "value")}
    return _rounded(windows.early_results(_events(t), ["user_id"], "ts", 86400, 6 * 3600, spec))


_OVER = {**SPEC, "mean": ("avg", "value")}
_OVER_SQL = """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS low,
               max(value) OVER w AS high, round(avg(value) OVER w + 1e-9, 5) AS mean FROM events WINDOW w AS ({})"""


def _over(df):
    return df.select(
        "event_id", "n", F.round("total", 4).alias("total"), "low", "high", F.round(F.col("mean") + 1e-9, 5).alias("mean")
    )


@query("over_rows_unbounded", _OVER_SQL.format("PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"))
def over_rows_unbounded(t):
    return _over(ordered.running(_events(t), ["event_type"], ["ts", "event_id"], _OVER))


@query(
    "over_range_unbounded",
    _OVER_SQL.format("PARTITION BY event_type ORDER BY time_bucket(INTERVAL 1 HOUR, ts) RANGE UNBOUNDED PRECEDING"),
)
def over_range_unbounded(t):
    """Rows of the same hour are peers and share one result."""
    hourly = _events(t).withColumn("hour", F.date_trunc("hour", "ts"))
    return _over(ordered.running(hourly, ["event_type"], ["hour"], _OVER, peers=True))


@query("over_rows_bounded", _OVER_SQL.format("PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING"))
def over_rows_bounded(t):
    return _over(ordered.over_rows(_events(t), ["user_id"], ["ts", "event_id"], 5, _OVER))


@query(
    "over_range_time",
    _OVER_SQL.format("PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW"),
)
def over_range_time(t):
    return _over(ordered.over_time(_events(t), ["event_type"], "ts", 7200, _OVER))


@query(
    "over_distinct",
    """SELECT event_id, CAST(len(list_distinct(list(event_type) OVER w)) AS BIGINT) AS kinds FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def over_distinct(t):
    """COUNT(DISTINCT x) OVER: count the first sight of every value, then run (A8 in O3)."""
    rows = _events(t).select("event_id", "user_id", "ts", "event_type")
    first = rows.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))
    marked = rows.join(first, ["user_id", "event_type"]).withColumn(
        "fresh", (F.col("event_id") == F.col("first_id")).cast("bigint")
    )
    return ordered.running(marked, ["user_id"], ["ts", "event_id"], {"kinds": ("sum", "fresh")}).select("event_id", "kinds")
