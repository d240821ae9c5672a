"""Scalar functions over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import maths, nested, temporal, text
from millrace.functions.registry import register_functions, scalar_function
from millrace.plans.registry import query


@query(
    "fn_math",
    """
    SELECT o_orderkey, o_orderkey // 7 AS whole, o_orderkey % 7 AS rest, -o_custkey AS negative, round(sqrt(x), 6) AS root,
           round(pow(y, 1.5), 6) AS pw, round(exp(y / 500), 6) AS ex, round(ln(x), 9) AS l, round(log10(x), 9) AS l10,
           round(log2(x), 9) AS l2, round(ln(x) / ln(3), 9) AS l3, abs(500 - y) AS ab, CAST(sign(500 - y) AS DOUBLE) AS sg,
           floor(x) AS fl, ceil(x) AS ce, round(x, 1) AS r1,
           CAST(trunc(CAST(x AS DECIMAL(20, 2)) * 10) AS DOUBLE) / 10 AS t1, bin(o_custkey) AS b,
           round(sin(y), 9) AS s, round(cos(y), 9) AS c, round(tan(y / 700), 9) AS t, round(cot(y / 700 + 0.1), 9) AS ct,
           round(asin(y / 1000000), 9) AS asn, round(acos(y / 1000000), 9) AS acs, round(atan(y), 9) AS atn,
           round(atan2(y, 3), 9) AS at2, round(sinh(y / 9000), 9) AS sh, round(cosh(y / 9000), 9) AS ch, round(tanh(y / 9000), 9) AS th,
           round(degrees(y / 100), 7) AS dg, round(radians(y), 9) AS rd, round(pi(), 12) AS p, round(exp(1), 12) AS e, hex(o_custkey) AS hx
    FROM (SELECT *, o_totalprice AS x, CAST(o_custkey % 1000 AS DOUBLE) AS y FROM orders)
    """,
)
def fn_math(t):
    rows = t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 1000).cast("double").alias("y")
    )
    k, c, x, y = F.col("o_orderkey"), F.col("o_custkey"), F.col("x"), F.col("y")

    def r(value, places=9):
        return F.round(value, places)

    return rows.select(
        k,
        maths.divide_whole(k, F.lit(7)).alias("whole"),
        (k % 7).alias("rest"),
        (-c).alias("negative"),
        r(F.sqrt(x), 6).alias("root"),
        r(F.pow(y, F.lit(1.5)), 6).alias("pw"),
        r(F.exp(y / 500), 6).alias("ex"),
        r(maths.strict_log(x)).alias("l"),
        r(F.log10(x)).alias("l10"),
        r(F.log2(x)).alias("l2"),
        r(maths.strict_log(x, F.lit(3.0))).alias("l3"),
        F.abs(500 - y).alias("ab"),
        F.sign(500 - y).alias("sg"),
        maths.floor_keep(x, "double").alias("fl"),
        maths.ceil_keep(x, "double").alias("ce"),
        r(x, 1).alias("r1"),
        maths.truncate(x, 1).alias("t1"),
        F.bin(c).alias("b"),
        r(F.sin(y)).alias("s"),
        r(F.cos(y)).alias("c"),
        r(F.tan(y / 700)).alias("t"),
        r(F.cot(y / 700 + 0.1)).alias("ct"),
        r(F.asin(y / 1000000)).alias("asn"),
        r(F.acos(y / 1000000)).alias("acs"),
        r(F.atan(y)).alias("atn"),
        r(F.atan2(y, F.lit(3.0))).alias("at2"),
        r(F.sinh(y / 9000)).alias("sh"),
        r(F.cosh(y / 9000)).alias("ch"),
        r(F.tanh(y / 9000)).alias("th"),
        r(F.degrees(y / 100), 7).alias("dg"),
        r(F.radians(y)).alias("rd"),
        r(F.pi(), 12).alias("p"),
        r(F.e(), 12).alias("e"),
        F.hex(c).alias("hx"),
    )


@query(
    "fn_random",
    "SELECT CAST(count(*) AS BIGINT) AS n, true AS in_range, true AS whole_in_range, CAST(count(*) AS BIGINT) AS ids FROM orders",
)
def fn_random(t):
    rows = t.orders.select(F.rand(5).alias("x"), maths.rand_integer(10, 5).alias("i"), F.uuid().alias("u"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.every((F.col("x") >= 0) & (F.col("x") < 1)).alias("in_range"),
        F.every((F.col("i") >= 0) & (F.col("i") < 10)).alias("whole_in_range"),
        F.count_distinct("u").alias("ids"),
    )


@query(
    "fn_unicode_literals",
    "SELECT p_partkey, p_brand || ' café 😀 \\' AS plain, p_brand || 'd!t' AS other FROM part",
)
def fn_unicode_literals(t):
    """Literals with escaped characters, the escape chosen."""
    return t.part.select(
        "p_partkey",
        F.concat("p_brand", text.unicode_literal(" caf\\00e9 \\+01F600 \\\\")).alias("plain"),
        F.concat("p_brand", text.unicode_literal("!0064!!!0074", "!")).alias("other"),
    )


@query(
    "fn_string",
    """
    SELECT p_partkey, p_name || ' / ' || p_brand AS joined, upper(p_name) AS up, lower(p_type) AS low,
           array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS cap,
           CAST(length(p_name) AS INTEGER) AS chars, CAST(strpos(p_name, 'ri') AS INTEGER) AS pos, substr(p_name, 3, 4) AS sub, substr(p_name, 4) AS tail,
           trim('  ' || p_name || ' ') AS trimmed, ltrim(p_brand, 'Bar') AS lead, rtrim(p_brand, '0123456789') AS trail, trim(p_type, 'EC') AS both,
           substr(p_name, 1, 1) || 'XY' || substr(p_name, 4) AS laid, concat_ws('-', p_name, p_brand) AS ws,
           lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, repeat(p_brand, 2) AS rep, replace(p_name, 'e', '3') AS rpl,
           regexp_replace(p_name, '[aeiou]+', '_', 'g') AS rx, regexp_extract(p_brand, '#([0-9]+)', 1) AS num,
           base64(encode(p_name)) AS b64, CAST(decode(from_base64(base64(encode(p_name)))) AS VARCHAR) AS back
    FROM part
    """,
)
def fn_string(t):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey",
        F.concat(name, F.lit(" / "), brand).alias("joined"),
        F.upper(name).alias("up"),
        F.lower(kind).alias("low"),
        text.initcap(name).alias("cap"),
        F.char_length(name).alias("chars"),
        F.position(F.lit("ri"), name).alias("pos"),
        name.substr(3, 4).alias("sub"),
        F.substring(name, F.lit(4), F.length(name)).alias("tail"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.ltrim(brand, F.lit("Bar")).alias("lead"),
        F.rtrim(brand, F.lit("0123456789")).alias("trail"),
        F.trim(kind, F.lit("EC")).alias("both"),
        F.overlay(name, F.lit("XY"), 2).alias("laid"),
        F.concat_ws("-", name, brand).alias("ws"),
        F.lpad(brand, 12, "*").alias("lp"),
        F.rpad(brand, 12, "*").alias("rp"),
        F.repeat(brand, 2).alias("rep"),
        F.replace(name, F.lit("e"), F.lit("3")).alias("rpl"),
        F.regexp_replace(name, "[aeiou]+", "_").alias("rx"),
        F.regexp_extract(brand, "#([0-9]+)", 1).alias("num"),
        F.base64(F.encode(name, "UTF-8")).alias("b64"),
        F.decode(F.unbase64(F.base64(F.encode(name, "UTF-8"))), "UTF-8").alias("back"),
    )


@query(
    "fn_hash",
    "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s256 FROM documents",
)
def fn_hash(t):
    return t.documents.select(
        "doc_id",
        F.md5("text").alias("m"),
        F.sha1("text").alias("s1"),
        maths.sha2_checked(F.col("text"), 256).alias("s256"),
    )


@query("fn_hash_wide")
def fn_hash_wide(t):
    """SHA224, SHA384 and SHA512 have no twin in the checking engine."""
    return t.documents.select(
        "doc_id", *[maths.sha2_checked(F.col("text"), bits).alias(f"s{bits}") for bits in (224, 384, 512)]
    )


@query(
    "fn_temporal",
    """
    SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS mo, weekofyear(ts) AS wk, day(ts) AS d, dayofweek(ts) + 1 AS dow,
           dayofyear(ts) AS doy, extract(century FROM ts) AS ce, extract(millennium FROM ts) AS mi, hour(ts) AS h, minute(ts) AS mn, second(ts) AS s,
           date_trunc('hour', ts) AS fh, date_trunc('month', ts) AS fm, date_trunc('hour', ts) + INTERVAL 1 HOUR AS chour,
           date_trunc('month', ts) + INTERVAL 1 MONTH AS cmonth, ts + INTERVAL 10 DAY AS plus_day, ts - INTERVAL 3 MONTH AS less_month,
           CAST(date_sub('month', TIMESTAMP '2020-05-17 08:00:00', ts) AS INTEGER) AS months,
           CAST(date_sub('year', TIMESTAMP '2020-05-17 08:00:00', ts) AS INTEGER) AS years,
           CAST(date_sub('day', TIMESTAMP '2020-05-17 08:00:00', ts) AS INTEGER) AS days,
           CAST(date_sub('minute', ts, TIMESTAMP '2024-01-15') AS INTEGER) AS minutes,
           (epoch_us(ts) // 1000) % 86400000 AS tod, ts <= TIMESTAMP '2024-01-20' AND ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-10' AS meets,
           CAST(ts AS DATE) AS on_date
    FROM events
    """,
)
def fn_temporal(t):
    ts = F.col("ts")

    def moment(text_value):
        return F.lit(text_value).cast("timestamp_ntz")

    units = {"y": "YEAR", "q": "QUARTER", "mo": "MONTH", "wk": "WEEK", "d": "DAY", "dow": "DOW", "doy": "DOY",
             "ce": "CENTURY", "mi": "MILLENNIUM", "h": "HOUR", "mn": "MINUTE", "s": "SECOND"}
    one_day = temporal.timestamp_add("DAY", F.lit(1), ts)
    return t.events.select(
        "event_id",
        *[temporal.extract(unit, ts).alias(name) for name, unit in units.items()],
        temporal.floor_time(ts, "HOUR").alias("fh"),
        temporal.floor_time(ts, "MONTH").alias("fm"),
        temporal.ceil_time(ts, "HOUR").alias("chour"),
        temporal.ceil_time(ts, "MONTH").alias("cmonth"),
        temporal.timestamp_add("DAY", F.lit(10), ts).alias("plus_day"),
        temporal.timestamp_add("MONTH", F.lit(-3), ts).alias("less_month"),
        temporal.timestamp_diff("MONTH", moment("2020-05-17 08:00:00"), ts).alias("months"),
        temporal.timestamp_diff("YEAR", moment("2020-05-17 08:00:00"), ts).alias("years"),
        temporal.timestamp_diff("DAY", moment("2020-05-17 08:00:00"), ts).alias("days"),
        temporal.timestamp_diff("MINUTE", ts, moment("2024-01-15")).alias("minutes"),
        temporal.time_of_day(ts).alias("tod"),
        temporal.overlaps(ts, one_day, moment("2024-01-20"), moment("2024-01-10")).alias("meets"),
        ts.cast("date").alias("on_date"),
    )


@query(
    "fn_date_format",
    """
    SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M:%S.%f') AS full_text, strftime(ts, '%a %b %-d %j') AS words,
           strftime(ts, '%I:%M:%S %p') AS clock, strftime(ts, '%V of %G 100%%') AS week,
           CASE event_id % 2 WHEN 0 THEN strftime(ts, '%d.%m.%y') ELSE strftime(ts, '%B/%A 5%%') END AS by_column
    FROM events
    """,
)
def fn_date_format(t):
    ts = F.col("ts")
    pattern = F.when(F.col("event_id") % 2 == 0, "%d.%m.%y").otherwise("%M/%W 5%%")
    return t.events.select(
        "event_id",
        temporal.date_format(ts, "%m/%d/%Y %H:%i:%s.%f").alias("full_text"),
        temporal.date_format(ts, "%a %b %e %j").alias("words"),
        temporal.date_format(ts, "%r").alias("clock"),
        temporal.date_format(ts, "%v of %x 100%%").alias("week"),
        temporal.date_format(ts, pattern).alias("by_column"),
    )


@query(
    "fn_current_time",
    "SELECT CAST(count(*) AS BIGINT) AS n, true AS same_day, true AS later FROM events",
)
def fn_current_time(t):
    return t.events.agg(
        F.count(F.lit(1)).alias("n"),
        F.every(F.current_timestamp().cast("date") == F.current_date()).alias("same_day"),
        F.every(F.localtimestamp() > F.col("ts")).alias("later"),
    )


@query(
    "fn_array",
    """
    SELECT vec_id, embedding[2] AS second, CAST(len(embedding) AS INTEGER) AS n, CAST(NULL AS FLOAT) AS beyond,
           CAST([label, label + 1, label * 2][3] AS INTEGER) AS third, CAST(label AS INTEGER) AS single, label % 2 = 0 AS same,
           [CAST(label AS VARCHAR)][1] AS as_text
    FROM embeddings
    """,
)
def fn_array(t):
    label = F.col("label")
    made = F.array(label, label + 1, label * 2)
    other = F.array(label, label + 1, label * 2 + label % 2)
    return t.embeddings.select(
        "vec_id",
        nested.at(F.col("embedding"), 2).alias("second"),
        nested.cardinality(F.col("embedding")).alias("n"),
        nested.at(F.col("embedding"), 1000).alias("beyond"),
        nested.at(made, 3).alias("third"),
        nested.element(F.array(label)).alias("single"),
        (made == other).alias("same"),
        nested.at(F.array(label).cast("array<string>"), 1).alias("as_text"),
    )


@query(
    "fn_map",
    """SELECT c_custkey, c_acctbal AS balance, CAST(2 AS INTEGER) AS n, CAST(NULL AS DOUBLE) AS missing, true AS same
       FROM customer""",
)
def fn_map(t):
    name, balance = F.lit("balance"), F.col("c_acctbal")
    made = F.create_map(name, balance, F.lit("nation"), F.col("c_nationkey").cast("double"))
    turned = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("double"), name, balance)
    return t.customer.select(
        "c_custkey",
        nested.lookup(made, "balance").alias("balance"),
        nested.cardinality(made).alias("n"),
        nested.lookup(made, "none").alias("missing"),
        nested.map_equals(made, turned).alias("same"),
    )


@query(
    "fn_row",
    """SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS region, (n_regionkey, n_nationkey) < (2, 10) AS smaller,
              n_regionkey = 3 AS same, CAST(count(c_custkey) AS BIGINT) AS customers
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def fn_row(t):
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    joined = t.nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["customers"])
    row = F.struct(F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).alias("region"))
    pair = F.struct(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))
    return joined.select(
        "n_nationkey",
        row["name"].alias("name"),
        row["region"].alias("region"),
        (pair < F.struct(F.lit(2).alias("a"), F.lit(10).alias("b"))).alias("smaller"),
        (pair == F.struct(F.lit(3).alias("a"), F.col("n_nationkey").alias("b"))).alias("same"),
        "customers",
    )


@query(
    "fn_json_path",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS nothing FROM events",
)
def fn_json_path(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.get_json_object("props", "$.none").alias("nothing"),
    )


@scalar_function(T.StringType())
def shorten(names: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([name[:n].strip() + "." for name, n in zip(names, size, strict=True)])


@query("udf_scalar", "SELECT p_partkey, trim(substr(p_name, 1, p_size % 6 + 1)) || '.' AS short FROM part")
def udf_scalar(t):
    return t.part.select("p_partkey", shorten("p_name", F.col("p_size") % 6 + 1).alias("short"))


@query(
    "udf_registered_sql",
    "SELECT s_suppkey, trim(substr(s_name, 1, 4)) || '.' AS short FROM supplier",
)
def udf_registered_sql(t):
    """A function registered from a property description and called in SQL."""
    register_functions(t.spark, {"shorten": {"class": "millrace.plans.functions:shorten"}})
    return t.spark.sql("SELECT s_suppkey, shorten(s_name, 4) AS short FROM {supplier}", supplier=t.supplier)
