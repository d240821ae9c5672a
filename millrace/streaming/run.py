"""Stream sources over files and sinks that end in a readable table."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.scratch import new_path
from millrace.session import ROCKSDB_PROVIDER
from millrace.sources.tables import Tables

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def rocksdb_state(spark: SparkSession, idle_batches: bool = True):
    """List, map and timer state needs the RocksDB provider; the earlier settings are put back.

    Processing-time state asks for another batch without end, so a bounded run of it must be started
    with ``idle_batches`` off.
    """
    wanted = {PROVIDER: ROCKSDB_PROVIDER, IDLE_BATCHES: str(idle_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def with_event_time(df: DataFrame, time: str) -> DataFrame:
    """Event time must be TIMESTAMP before a watermark can be set."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def is_folder(spark: SparkSession, path: str) -> bool:
    """A file source reads folders; a one-file table is read from its parent by name."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(hadoop_path).isDirectory()


def stream_table(t: Tables, name: str, time: str | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """A given table as a bounded stream of its files.

    ``bytes_per_trigger`` bounds a micro-batch, and with it what a task with Python state holds of a key.
    """
    reader = t.spark.readStream.schema(getattr(t, name).schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if is_folder(t.spark, t.path(name)):
        stream = reader.parquet(t.path(name))
    else:
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)
    return with_event_time(stream, time) if time else stream


def replay(df: DataFrame, steps: list) -> DataFrame:
    """A stream that delivers the rows matching each predicate of ``steps`` as one micro-batch, in order.

    Every step is written as the same number of files, which is the read limit of the stream. Rows are
    dealt out in turn, so with at least ``files`` rows in some input partition no file stays empty.
    """
    spark = df.sparkSession
    path = new_path(spark, "replay")
    sizes = df.agg(*[F.count_if(F.expr(step)).alias(f"s{i}") for i, step in enumerate(steps)]).first()
    kept = [(step, size) for step, size in zip(steps, sizes, strict=True) if size]
    inputs = df.rdd.getNumPartitions()
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, min([shuffled, *[size // inputs for _, size in kept]]))
    for step, _ in kept:
        df.where(step).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def checkpoint_path(spark: SparkSession) -> str:
    return new_path(spark, "checkpoint")


#: Later than any event; still inside the range of nanosecond times.
END_OF_TIME = "2261-01-01"


def ending(stream: DataFrame, time: str) -> tuple[DataFrame, Callable[[], None]]:
    """(the stream with an end, what to call when its input is used up).

    A bounded source ends with the greatest watermark: the call delivers one row of nulls at the end of time,
    after which every window, session and timer of real rows is over. Its own window never closes.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "end")
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(files)

    def finish() -> None:
        end = {time: F.lit(END_OF_TIME)}
        row = [end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
        spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(path)

    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), finish


def above_watermark(stream: DataFrame, time: str, condition) -> DataFrame:
    """Rows that meet ``condition``, tested after the watermark has seen all rows.

    A plain filter is pushed below the watermark, where it would also drop the row that ends the stream.
    """
    return stream.where(F.when(F.col(time).isNotNull(), condition).otherwise(F.lit(False)))


def append_table(stream: DataFrame, checkpoint: str | None = None, finish: Callable[[], None] | None = None) -> DataFrame:
    """Append sink: run what is available, then read the written rows.

    With ``finish`` (see :func:`ending`) the query goes on from its checkpoint once the end is delivered.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, "append"), checkpoint or checkpoint_path(spark)

    def available() -> None:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    available()
    if finish is not None:
        finish()
        available()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None
):
    """Run ``work(batch, id)`` for every micro-batch until the input is used up; returns the query."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or checkpoint_path(stream.sparkSession))
        .foreachBatch(work)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def batch_log(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Every emitted row with its micro-batch number ``_batch``; rewriting a batch replaces it."""
    spark = stream.sparkSession
    path = new_path(spark, "log")

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    each_batch(stream, work, mode, checkpoint)
    return spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(path)


def upsert_table(stream: DataFrame, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Upsert sink: the last emitted row of every key (update mode)."""
    log = batch_log(stream, "update", checkpoint)
    rest = [c for c in stream.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return latest.select(*keys, "_r.*")


def complete_table(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Materialised result: the whole result as of the last micro-batch (complete mode)."""
    spark = stream.sparkSession
    path = new_path(spark, "complete")
    last: list[int] = []

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[:] = [number]

    each_batch(stream, work, "complete", checkpoint)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}")


def side_outputs(stream: DataFrame, tags: dict[str, object], checkpoint: str | None = None) -> dict[str, DataFrame]:
    """Several outputs from one pass over the input: rows matching each tag's predicate."""
    spark = stream.sparkSession
    paths = {tag: new_path(spark, f"side-{tag}") for tag in tags}

    def work(batch: DataFrame, number: int) -> None:
        for tag, predicate in tags.items():
            batch.where(predicate).write.mode("overwrite").parquet(f"{paths[tag]}/_batch={number}")

    each_batch(stream, work, "append", checkpoint)
    return {tag: spark.read.schema(stream.schema).parquet(f"{path}/*") for tag, path in paths.items()}
