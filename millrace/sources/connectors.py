"""Options for external systems. Nothing here opens a connection; the caller loads or starts the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_source(
    servers: str, topics: list[str] | str, start: str = "group", offsets: dict | None = None, timestamp_ms: int | None = None,
    group: str | None = None, limit_per_trigger: int | None = None,
) -> dict[str, str]:
    """Reader options. ``topics`` is a list or a pattern; start is earliest, latest, group, timestamp or specific.

    ``group`` goes on from what a consumer group has committed; Spark does not read these offsets, so the
    caller gives them in ``offsets``. A stream that has a checkpoint goes on from there, whatever the start mode.
    """
    import json

    options = {"kafka.bootstrap.servers": servers}
    if isinstance(topics, str):
        options["subscribePattern"] = topics
    else:
        options["subscribe"] = ",".join(topics)
    if start in ("earliest", "latest"):
        options["startingOffsets"] = start
    elif start == "group":
        if not offsets:
            raise ValueError("start at a group's position needs its committed offsets {topic: {partition: offset}}")
        options["startingOffsets"] = json.dumps(offsets)
    elif start == "timestamp":
        if timestamp_ms is None:
            raise ValueError("start at a timestamp needs timestamp_ms")
        options["startingTimestamp"] = str(timestamp_ms)
    elif start == "specific":
        if not offsets:
            raise ValueError("specific start needs offsets {topic: {partition: offset}}")
        options["startingOffsets"] = json.dumps(offsets)
    else:
        raise ValueError(f"unknown start mode {start}")
    if group:
        options["kafka.group.id"] = group
    if limit_per_trigger:
        options["maxOffsetsPerTrigger"] = str(limit_per_trigger)
    return options


def kafka_json(records: DataFrame, schema: str, fail: bool = False) -> DataFrame:
    """Parse the values of Kafka records; the record time is kept as ``rowtime``."""
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST" if fail else "PERMISSIVE"})
    return records.select(F.col("timestamp").alias("rowtime"), parsed.alias("row")).select("rowtime", "row.*")


def avro_rows(records: DataFrame, schema_json: str, column: str = "value") -> DataFrame:
    """Parse Avro values; needs the spark-avro package on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return records.select(from_avro(column, schema_json).alias("row")).select("row.*")


def registry_avro_rows(records: DataFrame, schema_of_id: Callable[[int], str], ids: list[int], column: str = "value") -> DataFrame:
    """Avro values with a registry header: byte 0, a 4-byte schema id, then the record.

    The schemas of the given ids are looked up once on the driver.
    """
    from pyspark.sql.avro.functions import from_avro

    number = F.conv(F.hex(F.substring(column, 2, 4)), 16, 10).cast("int")
    body = F.expr(f"substring({column}, 6)")
    parts = [records.where(number == i).select(from_avro(body, schema_of_id(i)).alias("row")).select("row.*") for i in ids]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def kafka_records(df: DataFrame, key: str | None = None, partition: Column | None = None) -> DataFrame:
    """Rows as JSON values, ready for ``writeStream.format("kafka")``."""
    out = [F.to_json(F.struct(*df.columns)).alias("value")]
    if key:
        out.insert(0, F.col(key).cast("string").alias("key"))
    if partition is not None:
        out.append(partition.cast("int").alias("partition"))
    return df.select(*out)


def kafka_sink(servers: str, topic: str, transactional: bool = False) -> dict[str, str]:
    """Writer options; delivery is at least once, ``transactional`` only asks brokers to drop producer retries."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
    if transactional:
        options["kafka.enable.idempotence"] = "true"
    return options


def kinesis_source(stream: str, region: str, start: str = "latest", sequence: str | None = None) -> dict[str, str]:
    positions = {"latest": "LATEST", "earliest": "TRIM_HORIZON", "timestamp": "AT_TIMESTAMP", "sequence": "AT_SEQUENCE_NUMBER"}
    if start not in positions:
        raise ValueError(f"unknown start {start}")
    options = {"streamName": stream, "region": region, "initialPosition": positions[start]}
    if sequence:
        options["startingSequenceNumber"] = sequence
    return options


def between_predicates(column: str, low: int, high: int, rows_per_query: int) -> list[str]:
    """Non-overlapping BETWEEN ranges covering low..high, for ``spark.read.jdbc(predicates=...)``."""
    if high < low or rows_per_query < 1:
        raise ValueError("need low <= high and a positive size")
    return [f"{column} BETWEEN {a} AND {min(a + rows_per_query - 1, high)}" for a in range(low, high + 1, rows_per_query)]


def parameter_predicates(template: str, parameters: list[tuple]) -> list[str]:
    """One predicate per parameter row; ``?`` marks are filled with quoted literals."""
    def literal(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    out = []
    for row in parameters:
        pieces = template.split("?")
        if len(pieces) - 1 != len(row):
            raise ValueError("as many parameters as marks are needed")
        out.append("".join(p + (literal(row[i]) if i < len(row) else "") for i, p in enumerate(pieces)))
    return out


def jdbc_read(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict | None = None) -> DataFrame:
    """One partition per predicate."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})


def jdbc_sink(url: str, table: str, batch_rows: int = 5000, properties: dict | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends rows in batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.option("batchsize", batch_rows).jdbc(url, table, "append", properties or {})

    return write


def cassandra(keyspace: str, table: str, consistency: str = "LOCAL_QUORUM") -> dict[str, str]:
    return {"keyspace": keyspace, "table": table, "spark.cassandra.output.consistency.level": consistency}


def hbase_schema(families: dict[str, dict[str, str]], row_key: str = "rowkey", key_type: str = "string") -> str:
    """DDL of an HBase table: the row key, then a struct per column family."""
    structs = [f"`{f}` struct<{', '.join(f'`{q}`: {t}' for q, t in columns.items())}>" for f, columns in families.items()]
    return ", ".join([f"`{row_key}` {key_type}", *structs])


def elasticsearch(nodes: str, index: str, key: str | None = None, operation: str = "index") -> dict[str, str]:
    if operation not in ("index", "create", "update", "upsert", "delete"):
        raise ValueError(f"unknown operation {operation}")
    options = {"es.nodes": nodes, "es.resource": index, "es.write.operation": operation}
    if key:
        options["es.mapping.id"] = key
    elif operation in ("update", "upsert", "delete"):
        raise ValueError(f"{operation} needs a key")
    return options


def batch_sink(form: str, options: dict[str, str], mode: str = "append") -> Callable[[DataFrame, int], None]:
    """Any batch writer as a ``foreachBatch`` sink (search index, queue or store connectors)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.format(form).options(**options).mode(mode).save()

    return write


# The parts of a line of the edit feed: [[title]] flags url * user * (signed bytes) summary
EDIT_PARTS = {
    "title": r"\[\[(?<title>.+?)\]\]",
    "flags": r"(?<flags>[A-Z!]*)",
    "url": r"(?<url>https?://\S+)",
    "user": r"\* (?<user>.+?) \*",
    "bytes": r"\((?<bytes>[+-]?[0-9]+)\)",
    "summary": r"(?<summary>.*)",
}
EDIT_LINE = "^" + " ".join(EDIT_PARTS.values()) + "$"


def edit_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Edit events out of text lines; lines of another shape are dropped."""

    def part(name):
        return F.regexp_extract(column, EDIT_LINE, list(EDIT_PARTS).index(name) + 1)

    flags = part("flags")
    return lines.where(F.col(column).rlike(EDIT_LINE)).select(
        part("title").alias("title"),
        part("url").alias("diff_url"),
        part("user").alias("user"),
        part("bytes").cast("int").alias("byte_diff"),
        part("summary").alias("summary"),
        flags.contains("N").alias("is_new"),
        flags.contains("M").alias("is_minor"),
        flags.contains("B").alias("is_bot"),
        flags.contains("!").alias("is_unpatrolled"),
    )


def enrich_async(df: DataFrame, fetch: Callable[[tuple], tuple], keys: list[str], schema: str, capacity: int = 16, timeout: float = 10.0) -> DataFrame:
    """Look rows up in an outside service: up to ``capacity`` calls at a time per task, in input order.

    ``fetch`` gets the key values and returns the new column values; a call over ``timeout`` fails the task.
    """
    from concurrent.futures import ThreadPoolExecutor

    def task(batches):
        import pandas as pd

        with ThreadPoolExecutor(capacity) as pool:
            for batch in batches:
                calls = [pool.submit(fetch, key) for key in batch[keys].itertuples(index=False, name=None)]
                found = pd.DataFrame([c.result(timeout=timeout) for c in calls], index=batch.index)
                added = pd.concat([batch, found], axis=1)
                added.columns = names
                yield added

    extra = df.sparkSession.createDataFrame([], schema).schema
    names = [*df.columns, *extra.fieldNames()]
    from pyspark.sql.types import StructType

    return df.mapInPandas(task, StructType([*df.schema.fields, *extra.fields]))
