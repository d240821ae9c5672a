"""Sources, sinks and declared tables: written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.scratch import new_path
from millrace.sources import connectors, describe, files
from millrace.streaming import run

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_FIELDS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("io_csv", f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM ({_ORDERS})")
def io_csv(t):
    """Delimiter, header and a field mask."""
    path = new_path(t.spark, "csv")
    files.write_csv(_orders(t), path, field_delimiter="|", files=4, header="true")
    return files.read_csv(t.spark, path, _FIELDS, ["o_orderkey", "o_totalprice", "o_orderpriority"],
                          field_delimiter="|", ignore_first_line=True)


@query("io_csv_stream", f"SELECT o_orderkey, o_totalprice FROM ({_ORDERS}) WHERE o_orderstatus = 'F'")
def io_csv_stream(t):
    path = new_path(t.spark, "csv")
    files.write_csv(_orders(t), path)
    rows = files.stream_csv(t.spark, path, _FIELDS).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return run.append_table(rows)


@query("io_text_gzip", "SELECT '(' || n_nationkey || ',' || n_name || ',' || c_custkey || ')' AS value FROM nation JOIN customer ON n_nationkey = c_nationkey")
def io_text_gzip(t):
    """Lines through a compressed text file."""
    path = new_path(t.spark, "text")
    rows = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "n_name", "c_custkey")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in rows.columns]
    line = F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")")).alias("value")
    rows.select(line).write.option("compression", "gzip").text(path)
    return files.read_lines(t.spark, path)


@query("io_primitives", "SELECT o_totalprice AS value FROM orders")
def io_primitives(t):
    path = new_path(t.spark, "numbers")
    t.orders.select(F.col("o_totalprice").cast("string")).write.text(path)
    return files.read_primitives(t.spark, path, "double")


@query("io_json", _ORDERS)
def io_json(t):
    path = new_path(t.spark, "json")
    _orders(t).write.json(path)
    return files.read_json(t.spark, path, _FIELDS, fail_on_missing_field=True)


@query("io_orc", f"SELECT o_orderkey, o_totalprice FROM ({_ORDERS}) WHERE o_totalprice > 200000")
def io_orc(t):
    """Column projection and predicate reach the ORC scan."""
    path = new_path(t.spark, "orc")
    _orders(t).write.orc(path)
    return t.spark.read.orc(path).where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("io_parquet_nested", "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_totalprice > 200000")
def io_parquet_nested(t):
    """Nested projection and a nested predicate reach the Parquet scan."""
    path = new_path(t.spark, "nested")
    nested = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    t.orders.select("o_orderkey", nested.alias("info")).write.parquet(path)
    rows = t.spark.read.parquet(path).where("info.price > 200000")
    return rows.select("o_orderkey", F.col("info.status").alias("status"), F.col("info.price").alias("price"))


@query("io_bucketed", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def io_bucketed(t):
    """A folder per day."""
    path = new_path(t.spark, "buckets")
    files.write_bucketed(t.events, path, "ts", "yyyy-MM-dd", max_records=100_000)
    rows = t.spark.read.option("recursiveFileLookup", "false").parquet(path)
    return rows.groupBy(F.date_format(F.col("bucket").cast("timestamp"), "yyyy-MM-dd").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("io_libsvm", "SELECT CAST(label AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS n, CAST(64 * count(*) AS BIGINT) AS cells FROM embeddings GROUP BY 1")
def io_libsvm(t):
    """Written with 1-based indices, read back 0-based."""
    from pyspark.ml.functions import vector_to_array

    path = new_path(t.spark, "libsvm")
    files.write_libsvm(t.embeddings, "label", "embedding", path)
    rows = files.read_libsvm(t.spark, path, 64).select("label", F.size(vector_to_array("features")).alias("size"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cells"))


@query("io_sequence_file", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def io_sequence_file(t):
    """Key and value records (S25); pairs are made and read in the tasks."""
    path = new_path(t.spark, "sequence")
    t.supplier.select("s_suppkey", "s_name").rdd.map(lambda r: (r[0], r[1])).saveAsSequenceFile(path)
    return files.read_sequence_file(t.spark, path, "id bigint, name string")


@query("io_values", "SELECT c_custkey, c_acctbal * weight AS weighted FROM customer JOIN (VALUES ('BUILDING', 1.5::DOUBLE), ('MACHINERY', 2.5)) v(k, weight) ON c_mktsegment = k")
def io_values(t):
    """A literal table joined to a given one."""
    return t.spark.sql(
        "SELECT c_custkey, c_acctbal * weight AS weighted FROM {customer} JOIN VALUES ('BUILDING', 1.5D), ('MACHINERY', 2.5D) AS v(k, weight) ON c_mktsegment = k",
        customer=t.customer,
    )


@query("io_sequence", "SELECT CAST(i AS BIGINT) AS id, o_totalprice FROM (SELECT unnest(generate_series(0, (SELECT max(o_orderkey) FROM orders))) AS i) JOIN orders ON o_orderkey = i")
def io_sequence(t):
    """A generated sequence as long as the order keys, joined to them."""
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    return t.spark.range(last + 1).join(t.orders, F.col("id") == F.col("o_orderkey")).select("id", "o_totalprice")


@query("io_predicates", "SELECT o_orderkey, o_totalprice FROM orders")
def io_predicates(t):
    """The ranges of a parallel read, each as one branch: together they give every row once."""
    ends = t.orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    size = max(1, (ends[1] - ends[0] + 1) // 8 + 1)
    parts = [t.orders.where(p) for p in connectors.between_predicates("o_orderkey", ends[0], ends[1], size)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("o_orderkey", "o_totalprice")


@query(
    "io_edit_lines",
    """SELECT c_name AS title, c_mktsegment AS "user", CAST(trunc(c_acctbal) AS INTEGER) AS byte_diff, c_nationkey % 2 = 0 AS is_bot FROM customer
       WHERE c_acctbal >= 0""",
)
def io_edit_lines(t):
    """Text lines of the edit feed, parsed."""
    flags = F.when(F.col("c_nationkey") % 2 == 0, "MB").otherwise("M")
    change = F.col("c_acctbal").cast("int").cast("string")
    line = F.concat(F.lit("[["), "c_name", F.lit("]] "), flags, F.lit(" http://example.org/d * "), "c_mktsegment", F.lit(" * (+"), change, F.lit(") changed"))
    parsed = connectors.edit_events(t.customer.where("c_acctbal >= 0").select(line.alias("value")))
    return parsed.select("title", "user", "byte_diff", "is_bot")


@query("declared_table", "SELECT event_id AS id, user_id AS who, date_trunc('milliseconds', ts) AS at, value FROM events")
def declared_table(t):
    """Connector, format and schema by description, with renamed fields and a rowtime from milliseconds."""
    path = new_path(t.spark, "declared")
    millis = F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms")
    t.events.select("event_id", "user_id", millis, "value").write.json(path)
    schema = describe.Schema().field("id", "bigint", "event_id").field("who", "bigint", "user_id").rowtime("at", "bigint", "time_ms", "5 seconds")
    table = describe.connect(t.spark, path).with_format("json").with_schema(schema.field("value", "double")).in_append_mode()
    return table.source().withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "declared_environment",
    """SELECT e.event_id, o_orderkey FROM (SELECT event_id, user_id AS k, TIMESTAMP '2001-01-01' + (ts - TIMESTAMP '2024-01-01') AS at FROM events WHERE value > 50) e
       ASOF JOIN (SELECT o_custkey AS k, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o
       ON e.k = o.k AND e.at >= o.o_orderdate""",
)
def declared_environment(t):
    """Tables, a view and a history table from one description."""
    tables = {name: {"path": t.path(name)} for name in ("events", "orders")}
    views = {
        "dear_events": "SELECT event_id, user_id AS k, TIMESTAMP_NTZ '2001-01-01' + (ts - TIMESTAMP_NTZ '2024-01-01') AS at FROM events WHERE value > 50",
        "order_history": "SELECT o_custkey AS k, o_orderdate, o_orderkey FROM orders",
    }
    temporal = {"versions": {"history": "order_history", "key": "k", "time": "o_orderdate", "tie": "o_orderkey"}}
    made = describe.register_all(t.spark, {"tables": tables, "views": views, "temporal": temporal})
    return made["versions"].join(t.spark.table("dear_events"), "at", ["o_orderkey"]).select("event_id", "o_orderkey")


@query(
    "table_statistics",
    """SELECT 'o_orderkey' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(NULL AS INTEGER) AS max_length,
         CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max FROM orders
       UNION ALL SELECT 'o_orderpriority', count(*), 0, CAST(max(length(o_orderpriority)) AS INTEGER), min(o_orderpriority), max(o_orderpriority) FROM orders""",
)
def table_statistics(t):
    stats = describe.table_statistics(t.orders.select("o_orderkey", "o_orderpriority"))
    return stats.select("column", "rows", "nulls", "max_length", "min", "max")


@query("insert_into_table", "SELECT n_nationkey, n_name, CAST(count(*) AS BIGINT) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def insert_into_table(t):
    """Rows checked against the target's columns before they are inserted."""
    path = new_path(t.spark, "target")
    schema = describe.Schema().field("n_nationkey", "int").field("n_name", "string").field("customers", "bigint")
    counted = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.nation.join(counted, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "n_name", "n")
    table = describe.connect(t.spark, path).with_schema(schema)
    table.sink(rows)
    return table.source()


@query("async_enrichment", "SELECT c_custkey, c_nationkey, c_nationkey * 10 + 1 AS code FROM customer")
def async_enrichment(t):
    """Each row looked up in a (here local) service, many calls at a time."""
    rows = t.customer.select("c_custkey", "c_nationkey")
    return connectors.enrich_async(rows, lambda key: (key[0] * 10 + 1,), ["c_nationkey"], "code int")
