"""Late rows and event-time order, decided per micro-batch against the time seen before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.scratch import new_path
from millrace.streaming.run import each_batch


class SeenTime:
    """Greatest event time of the earlier micro-batches, kept as one small file per batch."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, new_path(spark, "seen")

    def before(self, number: int):
        """Microseconds, or None for the first batch."""
        if number == 0:
            return None
        seen = self.spark.read.schema("at bigint, _batch bigint").parquet(self.path)
        return seen.where(F.col("_batch") < number).agg(F.max("at")).first()[0]

    def note(self, batch: DataFrame, time: str, number: int) -> int | None:
        newest = batch.agg(F.max(F.unix_micros(time)).alias("at"))
        newest.write.mode("overwrite").parquet(f"{self.path}/_batch={number}")
        return self.spark.read.parquet(f"{self.path}/_batch={number}").first()[0]


def split_late(stream: DataFrame, time: str, lateness_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows): late means more than ``lateness_seconds`` behind the earlier batches."""
    spark = stream.sparkSession
    seen, good, late = SeenTime(spark), new_path(spark, "in-time"), new_path(spark, "late")

    def work(batch: DataFrame, number: int) -> None:
        mark = seen.before(number)
        limit = F.lit(None).cast("bigint") if mark is None else F.lit(mark - lateness_seconds * 1_000_000)
        is_late = F.coalesce(F.unix_micros(time) < limit, F.lit(False))
        batch.where(~is_late).write.mode("overwrite").parquet(f"{good}/_batch={number}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{late}/_batch={number}")
        seen.note(batch, time, number)

    each_batch(stream, work)
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{good}/*"), read.parquet(f"{late}/*")


def sort_stream(stream: DataFrame, time: str, delay_seconds: int) -> DataFrame:
    """Rows in event-time order: each batch releases what the watermark has passed, late rows are dropped.

    When the input is used up, the rows that still wait follow as a last batch.

    The result carries ``_batch``; every batch's rows are later than those of the batches before it, so
    (``_batch``, time) is the output order. Rows not yet passed wait in a table for the next batch.
    """
    spark = stream.sparkSession
    seen, out, wait = SeenTime(spark), new_path(spark, "sorted"), new_path(spark, "waiting")
    delay = delay_seconds * 1_000_000

    def work(batch: DataFrame, number: int) -> None:
        before = seen.before(number)
        newest = seen.note(batch, time, number)
        at = F.unix_micros(time)
        rows = batch if before is None else batch.where(at > before - delay)
        if number:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{wait}/{number - 1}"))
        mark = max(m for m in (before, newest) if m is not None) - delay
        ready = rows.where(at <= mark)
        count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ready.repartitionByRange(count, time).sortWithinPartitions(time).write.mode("overwrite").parquet(
            f"{out}/_batch={number}"
        )
        rows.where(at > mark).write.mode("overwrite").parquet(f"{wait}/{number}")
        last[:] = [number]

    last: list[int] = []
    each_batch(stream, work)
    if last:
        rest = spark.read.schema(stream.schema).parquet(f"{wait}/{last[0]}")
        count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rest.repartitionByRange(count, time).sortWithinPartitions(time).write.mode("overwrite").parquet(f"{out}/_batch={last[0] + 1}")
    return spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(out)


def sort_arrivals(stream: DataFrame, by: list[str]) -> DataFrame:
    """Rows in order of arrival: a micro-batch is one processing time, its rows are ordered by ``by``.

    (``_batch``, ``by``) is the output order.
    """
    spark = stream.sparkSession
    out = new_path(spark, "arrivals")

    def work(batch: DataFrame, number: int) -> None:
        count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        batch.repartitionByRange(count, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{out}/_batch={number}")

    each_batch(stream, work)
    return spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(out)


def feedback(stream: DataFrame, body, leave, max_rounds: int | None = None) -> DataFrame:
    """Feedback loop: each micro-batch runs through ``body`` until every row meets ``leave``.

    Rows that leave are written; the others go round again, as a written table. The result has the
    column ``round``: how often the row went through the body. Raises if rows are left after ``max_rounds``.
    """
    spark = stream.sparkSession
    out, loop = new_path(spark, "left"), new_path(spark, "loop")
    columns = []

    def work(batch: DataFrame, number: int) -> None:
        rows, turn = batch.withColumn("round", F.lit(0)), 0
        if not columns:
            columns.append(rows.schema)
        while True:
            done = rows.where(leave)
            done.write.mode("overwrite").parquet(f"{out}/_batch={number}/_turn={turn}")
            again = body(rows.where(~leave)).withColumn("round", F.col("round") + 1).select(*rows.columns)
            again.write.mode("overwrite").parquet(f"{loop}/{number}-{turn}")
            rows = spark.read.schema(again.schema).parquet(f"{loop}/{number}-{turn}")
            turn += 1
            if rows.isEmpty():
                return
            if max_rounds is not None and turn > max_rounds:
                raise RuntimeError(f"rows still circulate after {max_rounds} rounds")

    each_batch(stream, work)
    return spark.read.schema(columns[0]).parquet(f"{out}/*/*")
