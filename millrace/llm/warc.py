"""WARC files of web pages and a Merkle audit of their replicas.

Pages are written in the order of their ids into files of at most ``RECORDS`` records, each record a gzip member of its
own, with an index of their offsets. The audit reads the offset ranges of the index from every replica and
hashes them. Hashes of ordered, neighbouring ranges are hashed together, ``FAN`` at a time, up to one root: records
into files, files into what one task wrote, those into the whole. Two replicas are equal if their roots are;
otherwise only children of nodes that differ are compared, level by level, down to the damaged ranges.

The trees are tables (a level each), so a replica of any size is hashed in tasks of a file each and compared
by joins whose size is that of the damage. Files are named by the attempt that wrote them and count only if
the index, a table that Spark commits, names them.

A null url gives a record without one, a null html an empty record, null ids sort first and repeated rows are records of
their own; an empty table gives no files and equal (missing) roots. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import sliced
from millrace.llm.seekable import opened
from millrace.scratch import new_path, written

FAN_BITS, RECORD_BITS = 4, 8
FAN, RECORDS = 1 << FAN_BITS, 1 << RECORD_BITS
DATE = "2024-01-01T00:00:00Z"

INDEX = "part int, file int, record int, path string, page_id long, offset long, length long"
LEAF = "replica int, place long, page_id long, path string, offset long, length long, size long, hash binary"


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC record as a gzip member; the same page gives the same bytes."""
    block = (html or "").encode()
    digest = hashlib.sha256(block).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += ["Content-Type: text/html", f"WARC-Block-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into files; returns the index of their records."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, record, stream, path, at = TaskContext.get().partitionId(), -1, RECORDS, None, "", 0
        fs, inner = opened(folder)
        for batch in sliced(batches, "html"):
            out: list[list] = [[], [], [], [], [], [], []]
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                if record == RECORDS:
                    if stream is None:
                        fs.create_dir(inner, recursive=True)
                    else:
                        stream.close()
                    number, record, at = number + 1, 0, 0
                    name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder}/{name}"
                    stream = fs.open_output_stream(f"{inner}/{name}", compression=None)
                data = record_bytes(page_id, url, html)
                stream.write(data)
                for column, value in zip(out, (part, number, record, path, page_id, at, len(data))):
                    column.append(value)
                record, at = record + 1, at + len(data)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["part", "file", "record", "path", "page_id", "offset", "length"]
            )
        if stream is not None:
            stream.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.monotonically_increasing_id().alias("at"))
    ordered = rows.repartitionByRange("page_id", "at").sortWithinPartitions("page_id", "at")
    return written(ordered.select("page_id", "url", "html").mapInArrow(write, INDEX), "warc-index")


def by_file(index: DataFrame) -> DataFrame:
    """Index rows with those of a file together and in order."""
    return index.repartition("path").sortWithinPartitions("path", "offset")


def replicate(index: DataFrame, folder: str | None = None, damage: Column | None = None) -> DataFrame:
    """Copy all files; (path, copy) of each. ``damage`` says in which records a bit of the copy is turned over."""
    folder = folder or new_path(index.sparkSession, "warc-copy")
    harmed = F.lit(False) if damage is None else F.coalesce(damage, F.lit(False))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, inner), now, source, target, done = opened(folder), None, None, None, []
        for batch in batches:
            for path, offset, length, harm in zip(*[c.to_pylist() for c in batch.columns]):
                if path != now:
                    if now is None:
                        fs.create_dir(inner, recursive=True)
                    else:
                        source.close()
                        target.close()
                    now, name = path, f"copy-{uuid.uuid4().hex}-{path.rsplit('/', 1)[1]}"
                    files, own = opened(path)
                    source, target = files.open_input_file(own), fs.open_output_stream(f"{inner}/{name}", compression=None)
                    done.append((path, f"{folder}/{name}"))
                data = source.read_at(length, offset)
                if harm:
                    middle = length // 2
                    data = data[:middle] + bytes([data[middle] ^ 1]) + data[middle + 1 :]
                target.write(data)
        if now is not None:
            source.close()
            target.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["path", "copy"])

    rows = by_file(index.select("path", "offset", "length", harmed.alias("harm")))
    return written(rows.mapInArrow(copy, "path string, copy string"), "warc-copies")


def leaves(index: DataFrame, replica: int, copies: DataFrame | None = None) -> DataFrame:
    """A row for each record of a replica: its place in the order of all records, and what is stored there.

    ``size`` is the number of bytes found in its range; the range of a file's last record is open at the
    end, so that bytes added to a file are found too. A file that is gone has sizes of 0 and no hashes.
    """
    rows = index.withColumn("copy", F.col("path")) if copies is None else index.join(copies, "path", "left")
    top = index.agg(F.max("file")).first()[0] or 0
    place = F.col("part").cast("long") * (1 << (top.bit_length() + RECORD_BITS)) + F.col("file") * RECORDS + F.col("record")
    last = index.groupBy("path").agg(F.max("record").alias("record"), F.lit(True).alias("last"))
    known = rows.join(last, ["path", "record"], "left").select("path", "copy", place.alias("place"), "page_id", "offset", "length", "last")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, size = None, None, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            for path, copy, place, page_id, offset, length, last in zip(*[c.to_pylist() for c in batch.columns]):
                if (path, copy) != now:
                    now = path, copy
                    if file is not None:
                        file.close()
                    file, size = None, 0
                    if copy is not None:
                        fs, inner = opened(copy)
                        try:
                            file = fs.open_input_file(inner)
                            size = file.size()
                        except FileNotFoundError:
                            pass
                found = max(size - offset, 0) if last else max(min(size - offset, length), 0)
                digest = None
                if found:
                    hashed, at = hashlib.sha256(), offset
                    while at < offset + found:
                        data = file.read_at(min(1 << 20, offset + found - at), at)
                        hashed.update(data)
                        at += len(data)
                    digest = hashed.digest()
                for column, value in zip(out, (replica, place, page_id, path, offset, length, found, digest)):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["replica", "place", "page_id", "path", "offset", "length", "size", "hash"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    ordered = known.repartition("path").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(read, LEAF)


def trees(records: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all replicas: (replica, place, hash); the last holds the roots, at place 0.

    A node hashes its children's places below it and their hashes, in order, so that a missing or moved child shows.
    """
    top = records.agg(F.max("place")).first()[0] or 0
    level = records.select("replica", "place", "hash")
    out = [level]
    for _ in range(max(-(-top.bit_length() // FAN_BITS), 1)):
        child = F.struct(
            F.pmod("place", F.lit(FAN)).alias("at"), F.coalesce(F.hex("hash"), F.lit("-")).alias("hash")
        )
        joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["at"], c["hash"])))
        level = written(
            level.groupBy("replica", F.shiftright("place", FAN_BITS).alias("place")).agg(
                F.unhex(F.sha2(joined, 256)).alias("hash")
            ),
            "tree",
        )
        out.append(level)
    return out


def differing(levels: list[DataFrame], first: int, second: int) -> DataFrame:
    """Places of the records that differ between two replicas, by descending from the roots."""
    parents = None
    for level in reversed(levels):
        if parents is not None:
            level = level.withColumn("parent", F.shiftright("place", FAN_BITS)).join(parents, "parent", "left_semi")
        of = lambda replica: F.max(F.when(F.col("replica") == replica, F.col("hash")))
        both = level.groupBy("place").agg(of(first).alias("a"), of(second).alias("b"))
        parents = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("place").alias("parent"))
    return parents.withColumnRenamed("parent", "place")


def audit(index: DataFrame, copies: DataFrame) -> DataFrame:
    """Records whose stored bytes differ between the files of the index and their copies.

    (page_id, path, offset, length, status): ``missing`` if the copy has no byte of the range, ``short`` if it has
    fewer, ``extended`` if the file goes on behind its last record, ``changed`` otherwise; ``source`` if the
    damage is in the file of the index itself.
    """
    records = written(leaves(index, 0).unionByName(leaves(index, 1, copies)), "fixity")
    places = differing(trees(records), 0, 1)
    found = records.join(places, "place", "left_semi")
    copy = found.where("replica = 1").select("place", "page_id", "path", "offset", "length", F.col("size").alias("there"))
    own = found.where("replica = 0").select("place", "size")
    status = (
        F.when(F.col("size") != F.col("length"), "source")
        .when(F.col("there") == 0, "missing")
        .when(F.col("there") < F.col("length"), "short")
        .when(F.col("there") > F.col("length"), "extended")
        .otherwise("changed")
    )
    return copy.join(own, "place").select("page_id", "path", "offset", "length", status.alias("status"))
