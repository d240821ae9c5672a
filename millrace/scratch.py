"""Written intermediate tables in the folder the cluster shares.

Loops and multi-pass operators cut their lineage here: the rows are written as Parquet to the
folder named by ``spark.checkpoint.dir`` and read back, so a lost executor never loses them. Loops
remove a round's table once the next one is written; what is left of a session's tables goes when
its JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
_own_folders: set[str] = set()
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; a folder of its own only inside one process (``local[n]``) with none set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    already = context.getCheckpointDir()
    if already:
        return already
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(_local_folders[app])
    return _local_folders[app]


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it names it)."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()), named


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in a part of it that is removed when this session's JVM ends."""
    own = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        files, named = _file_system(spark, own)
        files.mkdirs(named)
        files.deleteOnExit(named)
        _own_folders.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Remove the table behind a frame that :func:`written` returned; other frames are left alone."""
    path = _paths.pop(df, None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove what is below a path that :func:`new_path` returned."""
    files, named = _file_system(spark, path)
    files.delete(named, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written rows."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def numbered(df: DataFrame) -> DataFrame:
    """(row, doc): the rows of ``df`` as structs with a number each, written once.

    Passes that join on the number must all read this table: a scan may be split otherwise the next time.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    return written(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*names).alias("doc")), "numbered")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As :func:`written`, hashed on ``key`` into as many sorted buckets as a shuffle has partitions.

    Joins on ``key`` then read it as it lies: only the other side is shuffled. The table is taken out of the
    catalog at once; the frame keeps the files and their buckets.
    """
    spark = df.sparkSession
    path, name = new_path(spark, label), f"millrace_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key)
    dealt.option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    _paths[table] = path
    return table


def written_and_measured(df: DataFrame, label: str, **measures) -> tuple[DataFrame, dict]:
    """As :func:`written`, with aggregates observed during the same write (no second pass)."""
    measures = measures or {"rows": F.count(F.lit(1))}
    seen = Observation()
    columns = [column.alias(name) for name, column in measures.items()]
    table = written(df.observe(seen, *columns), label)
    return table, seen.get
