"""Token ids of documents in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, one for each document (a document of more than ``FRAME_IDS`` ids has
several, each of which can be read on its own), then a skippable frame with the document index, then a
skippable frame with the seek table in the public seekable layout: for each frame its compressed size, its
plain size and the low 32 bits of the XXH64 of its plain bytes; then the number of frames, a descriptor byte
and the magic number. Any zstandard reader can decompress the whole file; a reader of some documents reads the
two tables at the end and then only the frames it needs. Ids are little-endian, two bytes each if the
vocabulary allows it and four otherwise.

Writing follows the commit rule of a Spark writer: a task writes a file under a name of its own attempt and
returns a row about it; the manifest, a Parquet table that Spark commits, names the files that count. Lost or
repeated attempts leave files that nothing names. Files are reached through Arrow's file systems, so the
shared folder may be a mounted one or a store that Arrow knows.

Null texts are empty documents (the end id alone), a null document id sorts first, repeated ids are kept
next to each other, an empty table gives an empty manifest, and other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import sliced, texts_of
from millrace.llm.tokens import TOKENIZED_BYTES, encoder_of, vocabulary_path
from millrace.scratch import new_path

FRAME_IDS = 1 << 20
LEVEL = 3
# Fixed values of the public seekable layout.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "part int, path string, documents long, ids long, bytes long, first_id long, last_id long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def opened(uri: str):
    """(Arrow file system, path in it) of a shared path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes one file, frame by frame; keeps only the index in memory."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.documents: list[int | None] = []
        self.counts: list[int] = []

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for begin in range(0, max(len(ids), 1), FRAME_IDS):
            plain = ids[begin : begin + FRAME_IDS].astype(f"<u{self.width}").tobytes()
            frame = self.packer.compress(plain)
            self.table.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.put(frame)
        self.documents.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> None:
        known = np.array([d is not None for d in self.documents], np.uint8)
        ids = np.array([d or 0 for d in self.documents], "<i8")
        plain = known.tobytes() + ids.tobytes() + np.array(self.counts, "<u8").tobytes()
        body = struct.pack("<4sBQ", b"TIDX", self.width, len(ids)) + self.packer.compress(plain)
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        size = struct.pack("<Q", len(body) + 8)
        entries = np.array(self.table, "<u4").reshape(-1, 3).tobytes()
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        # the size of the index frame goes before the table's entries, in a skippable frame of its own
        self.put(struct.pack("<II", SKIPPABLE_INDEX, 8) + size)
        self.put(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + len(foot)) + entries + foot)
        self.stream.close()


class Reader:
    """Reads documents of one file; only the frames of the documents asked for are read and decompressed."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        frames, kind, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or kind != CHECKSUMS:
            raise ValueError("this is no seekable file with checksums")
        begin = size - 9 - 12 * frames
        self.table = np.frombuffer(file.read_at(12 * frames, begin), "<u4").reshape(-1, 3).astype(np.int64)
        (index,) = struct.unpack("<Q", file.read_at(8, begin - 16))
        body = file.read_at(index - 8, begin - 24 - index + 8)
        name, self.width, count = struct.unpack("<4sBQ", body[:13])
        plain = zstandard.ZstdDecompressor().decompress(body[13:])
        known = np.frombuffer(plain, np.uint8, count)
        ids = np.frombuffer(plain, "<i8", count, count)
        self.documents = [int(i) if k else None for k, i in zip(known, ids)]
        self.counts = np.frombuffer(plain, "<u8", count, 9 * count).astype(np.int64)
        each = np.maximum(-(-self.counts // FRAME_IDS), 1)
        self.first_frame = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])]).astype(np.int64)
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, position: int) -> np.ndarray:
        """Ids of the document at this position of the file, checked."""
        parts = []
        for k in range(self.first_frame[position], self.first_frame[position + 1]):
            packed, plain_size, check = self.table[k]
            plain = self.unpacker.decompress(self.file.read_at(int(packed), int(self.offsets[k])))
            if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            parts.append(np.frombuffer(plain, f"<u{self.width}"))
        return np.concatenate(parts)


def write_token_files(
    docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ascending doc_id order; returns the manifest.

    The rows are range-partitioned on (doc_id, position in the input), so that even one id that many rows
    share is dealt over several files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    path = tokenizer or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, writer, at = None, None, ""
        for batch in sliced(batches, limit=TOKENIZED_BYTES):
            if writer is None:
                encoder = encoder_of(path)
                fs, inner = opened(folder)
                fs.create_dir(inner, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                at = f"{folder}/{name}"
                writer = Writer(fs.open_output_stream(f"{inner}/{name}", compression=None), 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4)
            ids, offsets = encoder.encode(texts_of(batch))
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for k, doc_id in enumerate(names):
                writer.add(doc_id, np.append(ids[offsets[k] : offsets[k + 1]], end_id))
        if writer is not None:
            writer.close()
            named = [d for d in writer.documents if d is not None] or [None]
            row = [part, at, len(writer.counts), sum(writer.counts), writer.at, named[0], named[-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 5])],
                ["part", "path", "documents", "ids", "bytes", "first_id", "last_id"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    ordered = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    manifest = new_path(spark, "token-manifest")
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all files before each; it has one row for each file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: its start in the whole stream, its length, its checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = opened(row["path"])
                with fs.open_input_file(inner) as file:
                    reader = Reader(file)
                    starts = row["start"] + np.cumsum(reader.counts) - reader.counts
                    crcs = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(reader.counts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.documents, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(reader.counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.count()  # a number of files, not of documents
    spread_out = with_starts(manifest).repartitionByRange(max(files, 1), "part")
    return spread_out.mapInArrow(read, READ)


def read_documents(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of documents; files without them are not opened, other frames not read."""
    asked = sorted(set(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                fs, inner = opened(path)
                with fs.open_input_file(inner) as file:
                    reader = Reader(file)
                    at = [k for k, d in enumerate(reader.documents) if d in hits]
                    for k in at:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([reader.documents[k]], pa.int64()), pa.array([reader.ids(k).tolist()], pa.list_(pa.int32()))],
                            ["doc_id", "ids"],
                        )

    hits = set(asked)
    near = F.array(*[F.lit(d) for d in asked]) if asked else F.array().cast("array<bigint>")
    files = manifest.where(F.exists(near, lambda d: d.between(F.col("first_id"), F.col("last_id"))))
    return files.select("path").mapInArrow(read, "doc_id long, ids array<int>")


def token_files_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the files of ``docs`` and read all of them back."""
    return read_token_files(write_token_files(docs))
