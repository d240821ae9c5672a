"""Example applications."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.registry import scalar_function
from millrace.operators import joins, ordered, windows
from millrace.plans.registry import query
from millrace.streaming import run

# Word characters are a-z, A-Z, 0-9 and _ in both engines' patterns.
_NO_WORD = r"\W+"
_WORDS = r"SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM documents"


def _words(t):
    return t.documents.select("doc_id", F.explode(F.split(F.lower("text"), _NO_WORD)).alias("word")).where("word <> ''")


@query("word_count", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY 1")
def word_count(t):
    return _words(t).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "word_count_sql",
    f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY 1 HAVING count(*) > 20",
)
def word_count_sql(t):
    return t.spark.sql(
        r"""SELECT word, count(*) AS n FROM {docs} LATERAL VIEW explode(split(lower(text), '\\W+')) w AS word
            WHERE word <> '' GROUP BY word HAVING count(*) > 20""",
        docs=t.documents,
    )


@query("word_count_stream", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY 1")
def word_count_stream(t):
    words = run.stream_table(t, "documents").select(F.explode(F.split(F.lower("text"), _NO_WORD)).alias("word"))
    counts = words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return run.complete_table(counts)


@query(
    "word_count_windowed",
    r"""WITH w AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM
          (SELECT doc_id, regexp_split_to_array(lower(text), '\W+') AS a FROM documents)) WHERE word <> ''),
        i AS (SELECT word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) - 1 AS idx FROM w)
       SELECT word, CAST(idx // 150 AS BIGINT) AS "window", CAST(least(idx + 1, 250) AS BIGINT) AS n FROM i WHERE (idx + 1) % 150 = 0""",
)
def word_count_windowed(t):
    """Counts over the last 250 occurrences of a word, after every 150."""
    words = t.documents.select("doc_id", F.posexplode(F.split(F.lower("text"), _NO_WORD)).alias("pos", "word"))
    return windows.slide_rows(words.where("word <> ''"), ["word"], ["doc_id", "pos"], 250, 150, {"n": ("count", "*")})


@query(
    "weblog_antijoin",
    """SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
       WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000
       AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15')""",
)
def weblog_antijoin(t):
    """Filtered pages and ranks, without those visited lately."""
    pages = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    ranks = t.orders.where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    lately = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    visits = t.events.where((F.col("event_type") == "error") & lately).select("user_id")
    joined = pages.join(ranks, F.col("c_custkey") == F.col("o_custkey"))
    return joined.join(visits, F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey", "c_name", "o_orderkey")


@scalar_function(T.StringType())
def reword(message: pd.Series) -> pd.Series:
    return message.str.replace("^(?:click|view)$", "browse", regex=True)


@query(
    "sql_client_tumble",
    """SELECT user_id, regexp_replace(event_type, '^(click|view)$', 'browse') AS message, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""",
)
def sql_client_tumble(t):
    """Tumbling count per user and message rewritten by a user function."""
    worded = t.events.select("user_id", "ts", reword("event_type").alias("message"))
    out = windows.tumble(worded, ["user_id", "message"], "ts", "1 hour", {"n": ("count", "*")})
    return out.drop("window_end")


@query(
    "json_word_count",
    r"""SELECT role, word, CAST(count(*) AS BIGINT) AS n FROM
        (SELECT role, unnest(regexp_split_to_array(lower(text), '\W+')) AS word FROM conversations) WHERE length(word) > 4 GROUP BY ALL""",
)
def json_word_count(t):
    """Words of JSON messages by sender."""
    messages = t.conversations.select(F.to_json(F.struct(F.struct("role").alias("user"), F.col("text"))).alias("body"))
    schema = "user struct<role: string>, text string"
    parsed = messages.select(F.from_json("body", schema).alias("m")).select(F.col("m.user.role").alias("role"), F.col("m.text").alias("text"))
    words = parsed.select("role", F.explode(F.split(F.lower("text"), _NO_WORD)).alias("word")).where(F.length("word") > 4)
    return words.groupBy("role", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alert_counts",
    """WITH p AS (SELECT event_id, user_id, ts, event_type, json_extract_string(props, '$.k') AS k FROM events),
       hit AS (SELECT e.event_id, e.user_id, e.ts, r.event_id AS alert_id FROM p e JOIN p r ON r.user_id = e.user_id AND r.event_type = 'signup'
               AND e.ts > r.ts AND e.event_type = 'click' AND length(e.k) = length(r.k))
       SELECT event_id, user_id, alert_id, CAST(row_number() OVER (PARTITION BY user_id, alert_id ORDER BY ts, event_id) AS BIGINT) AS fired FROM hit""",
)
def alert_counts(t):
    """Rules of a customer checked on the customer's later events; how often each alert has fired."""
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), F.length(F.get_json_object("props", "$.k")).alias("digits")))
    rows = t.events.select("event_id", "user_id", "ts", "event_type", payload.alias("payload"))
    rule = F.struct(F.lit("$.digits").alias("path"), F.get_json_object("payload", "$.digits").alias("value"))
    kind = F.struct(F.lit("$.type").alias("path"), F.lit("click").alias("value"))
    rules = rows.where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("alert_id"), F.col("ts").alias("since"), F.array(kind, rule).alias("rules")
    ).dropDuplicates(["user_id", "alert_id"])
    met = rows.join(rules, "user_id").where("ts > since")
    qualified = met.where("forall(rules, r -> get_json_object(payload, r.path) = r.value)")
    counted = ordered.running(
        qualified.select("event_id", "user_id", "ts", "alert_id"), ["user_id", "alert_id"], ["ts", "event_id"], {"fired": ("count", "*")}
    )
    return counted.select("event_id", "user_id", "alert_id", "fired")


@query(
    "stream_broadcast_rules",
    """SELECT event_id, event_type, value FROM events JOIN (SELECT event_type AS kind, avg(value) AS usual FROM events GROUP BY 1)
       ON event_type = kind WHERE value > 2 * usual""",
)
def stream_broadcast_rules(t):
    """A stream against rules sent to every task, after counting them."""
    rules = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.avg("value").alias("usual"))
    rows = run.stream_table(t, "events", "ts").select("event_id", "event_type", "value")
    met = rows.join(joins.small(rules), F.col("event_type") == F.col("kind")).where("value > 2 * usual")
    return run.append_table(met.select("event_id", "event_type", "value"))


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * 6371 * 1000 * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def flying_carpet(distance: Column, average: Column, amount: Column) -> Column:
    """Far from the last transaction and an amount far off the average."""
    return (distance > 1000.0) & (average - amount > 2 * average)


@query(
    "fraud_features",
    """WITH p AS (SELECT event_id, user_id, ts, value - 245 AS amount, CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS lat, value / 3 AS lon FROM events),
       l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0,
             avg(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual
             FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       h AS (SELECT *, sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2 AS a FROM l WHERE ts0 IS NOT NULL)
       SELECT event_id, user_id, round(2 * 6371 * 1000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres, (epoch_us(ts) // 1000) - (epoch_us(ts0) // 1000) AS elapsed_ms,
              2 * 6371 * 1000 * atan2(sqrt(a), sqrt(1 - a)) > 1000 AND usual - amount > 2 * usual AS suspicious FROM h""",
)
def fraud_features(t):
    """Distance and time between a card's consecutive transactions."""
    rows = t.events.select(
        "event_id", "user_id", "ts", (F.col("value") - 245).alias("amount"),
        (F.get_json_object("props", "$.k").cast("double") - 50).alias("lat"), (F.col("value") / 3).alias("lon"),
    )
    order = ["ts", "event_id"]
    sliced = ordered.slice_rows(rows, ["user_id"], order)
    before = ordered.previous(sliced, ["user_id"], order, {"lat0": "lat", "lon0": "lon", "ts0": "ts"}, sliced=True)
    usual = ordered.running(before, ["user_id"], order, {"usual": ("avg", "amount")}, sliced=True, exclusive=True)
    metres = haversine_metres(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    elapsed = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("ts0").cast("timestamp"))
    return usual.where("ts0 IS NOT NULL").select(
        "event_id", "user_id", F.round(metres, 3).alias("metres"), elapsed.alias("elapsed_ms"),
        flying_carpet(metres, F.col("usual"), F.col("amount")).alias("suspicious"),
    )


@query(
    "fan_out_union",
    """SELECT kind, CAST(count(*) AS BIGINT) AS n, round(sum(v), 2) AS total FROM (
         SELECT 'order' AS kind, o_totalprice AS v FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem
         UNION ALL SELECT 'event', value FROM events UNION ALL SELECT 'event', value * 2 FROM events) GROUP BY 1""",
)
def fan_out_union(t):
    """Three sources, one of them fanned out, in one stream of records."""
    orders = t.orders.select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("v"))
    lines = t.lineitem.select(F.lit("line").alias("kind"), F.col("l_extendedprice").alias("v"))
    events = t.events.select(F.lit("event").alias("kind"), F.explode(F.array(F.col("value"), F.col("value") * 2)).alias("v"))
    return orders.union(lines).union(events).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))
