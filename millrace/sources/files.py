"""File readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_options(
    field_delimiter: str = ",", line_delimiter: str = "\n", quote: str | None = '"', comment: str | None = None,
    ignore_first_line: bool = False, lenient: bool = False,
) -> dict[str, str]:
    """Reader options; ``lenient`` drops lines that do not fit the schema, otherwise they are errors."""
    options = {
        "sep": field_delimiter,
        "lineSep": line_delimiter,
        "header": str(ignore_first_line).lower(),
        "enforceSchema": "true",
        "mode": "DROPMALFORMED" if lenient else "FAILFAST",
        "quote": quote or "",
    }
    if comment:
        options["comment"] = comment
    return options


def read_csv(spark: SparkSession, path: str, schema: StructType | str, mask: list[str] | None = None, **options) -> DataFrame:
    """Typed CSV; ``mask`` keeps some of the declared fields."""
    rows = spark.read.schema(schema).options(**csv_options(**options)).csv(path)
    return rows.select(*mask) if mask else rows


def stream_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**csv_options(**options)).csv(path)


def read_lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """One row per line, column ``value``; compressed files (gzip, bzip2, deflate) by extension."""
    if charset.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(path)
    options = {"sep": "\u0000", "quote": "", "encoding": charset}
    return spark.read.schema("value string").options(**options).csv(path)


def read_primitives(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One primitive per line."""
    return spark.read.text(path).select(F.col("value").cast(kind).alias("value"))


def read_json(spark: SparkSession, path: str, schema: StructType | str, fail_on_missing_field: bool = False) -> DataFrame:
    """JSON lines; malformed lines are errors, and missing fields too when asked for."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not fail_on_missing_field:
        return rows
    checks = [F.coalesce(F.col(c), F.raise_error(F.lit(f"field {c} is missing")).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]
    return rows.select(*checks)


def read_libsvm(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(label, features); indices in the file start at 1, in the vector at 0."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", size) if size else reader).load(path)


def write_libsvm(df: DataFrame, label: str, features: str, path: str) -> None:
    """Lines of ``label index:value ...``, 1-based, zeros left out."""
    items = F.filter(
        F.transform(features, lambda x, i: F.struct((i + 1).alias("i"), x.cast("double").alias("x"))), lambda e: e["x"] != 0
    )
    cells = F.transform(items, lambda e: F.concat(e["i"].cast("string"), F.lit(":"), e["x"].cast("string")))
    df.select(F.concat_ws(" ", F.col(label).cast("double").cast("string"), F.array_join(cells, " ")).alias("value")).write.text(path)


def read_sequence_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Key and value writables as two columns."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def read_hadoop(spark: SparkSession, path: str, input_format: str, key: str, value: str, schema: str, conf: dict | None = None) -> DataFrame:
    """Any Hadoop input format, by class names, as a key and a value column."""
    pairs = spark.sparkContext.newAPIHadoopFile(path, input_format, key, value, conf=conf)
    return spark.createDataFrame(pairs, schema)


def read_catalog(spark: SparkSession, table: str, columns: list[str] | None = None, partitions: str | None = None) -> DataFrame:
    """A catalog (Hive) table with a projection and a partition predicate, both pushed into the scan."""
    rows = spark.table(table)
    rows = rows.where(partitions) if partitions else rows
    return rows.select(*columns) if columns else rows


def monitor(
    spark: SparkSession, path: str, schema: StructType | str, form: str = "text", glob: str | None = None, files_per_trigger: int | None = None, **options
) -> DataFrame:
    """Files of a folder as a stream, whose names match ``glob``.

    Start it with ``trigger(availableNow=True)`` to read what is there once, or with a processing-time
    trigger to go on watching.
    """
    reader = spark.readStream.format(form).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_graph_csv(spark: SparkSession, edges: str, vertices: str | None = None, id_type: str = "bigint", value_type: str = "double", **options):
    """Edges (src, dst, value) and, if given, vertices (id, value); without them, the edges' endpoints."""
    from millrace.graph.frame import Graph

    e = read_csv(spark, edges, f"src {id_type}, dst {id_type}, value {value_type}", **options)
    if vertices is None:
        return Graph.from_edges(e)
    return Graph(read_csv(spark, vertices, f"id {id_type}, value {value_type}", **options), e)


def write_csv(df: DataFrame, path: str, field_delimiter: str = ",", files: int | None = None, overwrite: bool = False, **options) -> None:
    """``files`` limits the number of files; an existing path is an error unless ``overwrite``."""
    rows = df.coalesce(files) if files else df
    mode = "overwrite" if overwrite else "errorifexists"
    rows.write.mode(mode).options(sep=field_delimiter, escape='"', **options).csv(path)


def write_lines(df: DataFrame, path: str, template=None) -> None:
    """Rows as text; ``template`` is a column, by default the fields joined with commas in parentheses."""
    if template is None:
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]
        template = F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))
    df.select(template.alias("value")).write.text(path)


def write_bucketed(df: DataFrame, path: str, time: str, pattern: str = "yyyy-MM-dd--HH", form: str = "parquet", max_records: int | None = None) -> None:
    """One folder per formatted time. Rows of a bucket are gathered so that files stay few and large; a
    rebalance splits a bucket that is too large for one task."""
    rows = df.withColumn("bucket", F.date_format(time, pattern))
    gathered = rows.hint("rebalance", F.col("bucket"))
    writer = gathered.write.format(form).partitionBy("bucket")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.save(path)


def stream_bucketed(stream: DataFrame, path: str, checkpoint: str, time: str, pattern: str = "yyyy-MM-dd--HH", form: str = "parquet"):
    """The streaming form; files of a micro-batch are committed together (exactly once)."""
    rows = stream.withColumn("bucket", F.date_format(time, pattern))
    return rows.writeStream.format(form).partitionBy("bucket").option("path", path).option("checkpointLocation", checkpoint)
