"""Tables declared by description: connector, format, schema, time attributes, views and history tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.registry import register_functions
from millrace.functions.temporal import rowtime as to_rowtime
from millrace.operators import joins


class SchemaMismatch(ValueError):
    """Rows do not fit the table they are inserted into."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    origin: str | None = None
    role: str | None = None
    delay: str = "0 seconds"


@dataclass(frozen=True)
class Schema:
    """``Schema().field("id", "bigint").rowtime("ts", "bigint", origin="time", delay="5 seconds")``."""

    fields: tuple[Field, ...] = ()

    def field(self, name: str, kind: str, origin: str | None = None) -> Schema:
        return replace(self, fields=(*self.fields, Field(name, kind, origin)))

    def rowtime(self, name: str, kind: str, origin: str | None = None, delay: str = "0 seconds") -> Schema:
        """Event time from a bigint (ms), timestamp or text field, watermarked ``delay`` behind its maximum."""
        return replace(self, fields=(*self.fields, Field(name, kind, origin, "rowtime", delay)))

    def proctime(self, name: str) -> Schema:
        return replace(self, fields=(*self.fields, Field(name, "timestamp", None, "proctime")))

    def ddl(self) -> str:
        """The physical columns, under their names at the source."""
        return ", ".join(f"`{f.origin or f.name}` {f.kind}" for f in self.fields if f.role != "proctime")

    def apply(self, rows: DataFrame) -> DataFrame:
        out = []
        for f in self.fields:
            if f.role == "proctime":
                out.append(F.current_timestamp().alias(f.name))
            elif f.role == "rowtime":
                out.append(to_rowtime(F.col(f.origin or f.name), f.kind).alias(f.name))
            else:
                out.append(F.col(f.origin or f.name).alias(f.name))
        shaped = rows.select(*out)
        times = [f for f in self.fields if f.role == "rowtime"]
        return shaped.withWatermark(times[0].name, times[0].delay) if times and rows.isStreaming else shaped


MODES = {"append": "append", "retract": "update", "upsert": "update"}


@dataclass(frozen=True)
class Table:
    """``connect(spark, path).with_format("csv", header="true").with_schema(schema).in_append_mode()``."""

    spark: SparkSession
    path: str | None
    form: str = "parquet"
    options: dict = field(default_factory=dict)
    schema: Schema | None = None
    mode: str = "append"

    def with_format(self, form: str, **options) -> Table:
        return replace(self, form=form, options={**self.options, **options})

    def with_schema(self, schema: Schema) -> Table:
        return replace(self, schema=schema)

    def in_append_mode(self) -> Table:
        return replace(self, mode="append")

    def in_retract_mode(self) -> Table:
        return replace(self, mode="retract")

    def in_upsert_mode(self) -> Table:
        return replace(self, mode="upsert")

    def _load(self, reader) -> DataFrame:
        if self.schema is None:
            raise SchemaMismatch("a source needs a schema")
        if self.form != "kafka":
            reader = reader.schema(self.schema.ddl())
        reader = reader.format(self.form).options(**self.options)
        return self.schema.apply(reader.load(self.path) if self.path else reader.load())

    def source(self) -> DataFrame:
        return self._load(self.spark.read)

    def stream_source(self) -> DataFrame:
        return self._load(self.spark.readStream)

    def sink(self, rows: DataFrame, write_mode: str = "append") -> None:
        self._check(rows).write.format(self.form).options(**self.options).mode(write_mode).save(self.path)

    def stream_sink(self, rows: DataFrame, checkpoint: str):
        writer = self._check(rows).writeStream.format(self.form).options(**self.options).outputMode(MODES[self.mode])
        return writer.option("checkpointLocation", checkpoint)

    def _check(self, rows: DataFrame) -> DataFrame:
        if self.schema is None:
            return rows
        kinds = self.spark.createDataFrame([], self.schema.ddl()).dtypes
        return checked_insert(rows, kinds)

    def register_source(self, name: str) -> None:
        self.source().createOrReplaceTempView(name)


def connect(spark: SparkSession, path: str | None = None) -> Table:
    return Table(spark, path)


def checked_insert(rows: DataFrame, target: list[tuple[str, str]]) -> DataFrame:
    """Rows for INSERT INTO: as many columns as the target, of the same types, by position."""
    if len(rows.columns) != len(target):
        raise SchemaMismatch(f"{len(rows.columns)} columns into {len(target)}")
    for (name, kind), (goal, wanted) in zip(rows.dtypes, target, strict=True):
        if kind != wanted:
            raise SchemaMismatch(f"{name}: {kind} into {goal}: {wanted}")
    return rows.toDF(*[name for name, _ in target])


def insert_into(rows: DataFrame, table: str) -> None:
    checked_insert(rows, rows.sparkSession.table(table).dtypes).write.insertInto(table)


def table_statistics(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, distinct values, average and greatest length, least and greatest value."""
    from pyspark.sql.types import StringType

    pieces, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        size = F.length(c) if isinstance(f.dataType, StringType) else F.lit(None).cast("int")
        pieces += [
            F.count_if(c.isNull()).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}"), F.avg(size).alias(f"a{i}"),
            F.max(size).alias(f"m{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"),
        ]
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values"),
            F.col(f"a{i}").alias("average_length"), F.col(f"m{i}").alias("max_length"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        ))
    return df.agg(*pieces).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class TemporalTable:
    """A history table addressed by time: ``rates.join(orders, "order_time")``."""

    history: DataFrame
    key: str
    time: str
    tie: str

    def join(self, probes: DataFrame, time: str, columns: list[str], how: str = "inner") -> DataFrame:
        return joins.temporal_join(probes, self.history, self.key, time, self.time, self.tie, columns, how)

    def at(self, moment) -> DataFrame:
        """The latest version of every key at one moment."""
        valid = self.history.where(F.col(self.time) <= moment)
        latest = valid.groupBy(self.key).agg(F.max_by(F.struct("*"), F.struct(self.time, self.tie)).alias("r"))
        return latest.select("r.*")


def register_all(spark: SparkSession, environment: dict) -> dict[str, TemporalTable]:
    """Set up a session from a description.

    ``tables``: name -> {path, format, options, schema (a :class:`Schema`)}; ``views``: name -> SQL, in
    order; ``functions``: name -> function or properties; ``temporal``: name -> {history, key, time, tie}.
    """
    for name, entry in environment.get("tables", {}).items():
        table = connect(spark, entry["path"]).with_format(entry.get("format", "parquet"), **entry.get("options", {}))
        if "schema" in entry:
            table.with_schema(entry["schema"]).register_source(name)
        else:
            spark.read.format(table.form).options(**table.options).load(table.path).createOrReplaceTempView(name)
    register_functions(spark, environment.get("functions", {}))
    for name, text in environment.get("views", {}).items():
        spark.sql(text).createOrReplaceTempView(name)
    return {
        name: TemporalTable(spark.table(e["history"]), e["key"], e["time"], e["tie"])
        for name, e in environment.get("temporal", {}).items()
    }
