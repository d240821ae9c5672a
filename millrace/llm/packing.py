"""Vector best-fit packing of documents into training sequences.

Every piece of a document asks for three things: tokens (its length), one document place and attention cost
(its length squared). A sequence offers a capacity of each. Pieces are taken by falling length; of all open
sequences that have room for the piece in every dimension the best is chosen, either by the smallest weighted
norm of what would be left ("norm") or by the largest weighted dot product of the demand and what is left
("dot"); a new one is opened only if there is none.

Pieces of one length are interchangeable, and so are sequences in one state. The plan is therefore made for
*counts*: the driver gets the number of pieces of each length (at most as many rows as a sequence has tokens,
however many documents there are) and moves whole groups of like sequences at a time, which gives exactly the
bins that one-by-one best fit gives. The plan says, for each length, which ranks of its pieces go to which
run of sequences; tasks look their pieces up in it. Ranks come from counters inside the tasks and sums over
(task, length), so no group of equal lengths ever meets in one task.

Null texts are empty documents (one end id), ids may be null or repeated (each row is a document), an empty
table gives no rows and other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import sliced, texts_of
from millrace.llm.tokens import TOKENIZED_BYTES, encoder_of, vocabulary_path
from millrace.scratch import written

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BITS = 44


@dataclass(frozen=True)
class Capacity:
    """What a sequence offers; ``None`` leaves a dimension as wide as the tokens allow."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def filled(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2

    def longest(self) -> int:
        """The longest piece that fits into an empty sequence."""
        tokens, _, attention = self.filled()
        return min(tokens, math.isqrt(attention))


def cut(
    docs: DataFrame, longest: int, tokenizer: str | None = None, end_id: int = 2, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``longest`` ids of each document (doc_id, text), the end id counted.

    Only longer documents are cut; all their pieces are full but the first. ``keep_ids`` adds the ids.
    """
    path = tokenizer or vocabulary_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in sliced(batches, limit=TOKENIZED_BYTES):
            encoder = encoder or encoder_of(path)
            ids, offsets = encoder.encode(texts_of(batch))
            rows: list[list] = [[], [], [], [], []]
            kept = []
            for k, doc_id in enumerate(batch.column(batch.schema.get_field_index("doc_id")).to_pylist()):
                own = np.append(ids[offsets[k] : offsets[k + 1]], end_id).astype("<u4")
                head = len(own) % longest or longest
                for piece, begin in enumerate([0, *range(head, len(own), longest)]):
                    part = own[begin : head if not begin else begin + longest]
                    for column, value in zip(rows, (doc_id, piece, begin, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(rows, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, schema)


def plan(counts: dict[int, int], capacity: Capacity, weights: tuple[float, float, float], measure: str) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset): piece ``first rank + i`` goes to ``first sequence + i``."""
    whole = np.array(capacity.filled(), np.float64)
    weight = np.array(weights, np.float64)
    left = np.zeros((0, 3), np.int64)  # of each group of like open sequences
    first, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, sequences = [], 0
    smallest = min(counts, default=1)
    for length in sorted(counts, reverse=True):
        asked = np.array([length, 1, length * length], np.int64)
        most = int((np.array(capacity.filled()) // asked).min())
        if most < 1:
            raise ValueError(f"a piece of {length} tokens does not fit into a sequence")
        rank, todo = 0, counts[length]
        while todo:
            room = (left >= asked).all(axis=1)
            if room.any():
                if measure == "norm":
                    score = -(weight * ((left - asked) / whole) ** 2).sum(axis=1)
                elif measure == "dot":
                    score = (weight * (asked / whole) * (left / whole)).sum(axis=1)
                else:
                    raise ValueError("measure is norm or dot")
                best = int(np.argmax(np.where(room, score, -np.inf)))
                # by norm a sequence that just took a piece fits the next one better still; by dot product worse
                each = int((left[best] // asked).min()) if measure == "norm" else 1
                begin, many, state = int(first[best]), int(size[best]), left[best].copy()
                keep = np.arange(len(size)) != best
                left, first, size = left[keep], first[keep], size[keep]
            else:
                # nothing else has room, so a new sequence is filled before the next one is opened
                each, begin, many, state = most, sequences, -(-todo // most), np.array(capacity.filled(), np.int64)
                sequences += many
            full, rest = min(many, todo // each), 0
            if full < many:
                rest = todo - full * each
                if full and rest >= each:
                    rest = 0
            groups = [(begin, full, each)] if full else []
            used = full
            if full < many and rest:
                groups.append((begin + full, 1, rest))
                used += 1
            for at, n, times in groups:
                offset = int(whole[0]) - int(state[0])
                for k in range(times):
                    rows.append((length, rank, n, at, offset + k * length))
                    rank += n
                    todo -= n
                now = state - times * asked
                if now[0] >= smallest and now[1] >= 1 and now[2] >= smallest * smallest:
                    left = np.vstack([left, now])
                    first, size = np.append(first, at), np.append(size, n)
            if used < many:
                left = np.vstack([left, state])
                first, size = np.append(first, begin + used), np.append(size, many - used)
    return np.array(rows, np.int64).reshape(-1, 5)


def place(
    pieces: DataFrame,
    capacity: Capacity = Capacity(),
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    measure: str = "norm",
) -> DataFrame:
    """``pieces`` (any columns, with ``length``) with ``sequence_id`` and ``offset``; offsets have no gaps.

    Columns of the input with the names of the new ones (or of the four inner ones) are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "_part", "_rank", "_before", "_total")
    fields = pieces.schema.simpleString()[len("struct<") : -1]
    limit = capacity.longest()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(lengths) and (lengths.max() > limit or lengths.min() < 1):
                raise ValueError(f"pieces have 1 to {limit} tokens")
            order = np.argsort(lengths, kind="stable")
            starts = np.searchsorted(lengths[order], lengths[order])
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(lengths)) - starts
            rank += seen[lengths]
            seen += np.bincount(lengths, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank)],
                [*batch.schema.names, "_part", "_rank"],
            )

    numbered = written(pieces.mapInArrow(ranked, f"{fields}, _part int, _rank long"), "pieces")
    tallies = numbered.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, capacity, weights, measure)
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = tallies.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    keys = (rows[:, 0] << RANK_BITS) + rows[:, 1]
    order = np.argsort(keys)
    keys, to, at, begin = keys[order], rows[order, 3], rows[order, 4], rows[order, 1]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: i for i, n in enumerate(batch.schema.names)}
            lengths = batch.column(get["length"]).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(get["_total"]).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(keys, (lengths << RANK_BITS) + rank, side="right") - 1
            out = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_total"]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(to[k] + rank - begin[k]), pa.array(at[k])],
                [*[n for n in batch.schema.names if n != "_total"], "sequence_id", "offset"],
            )

    placed = numbered.join(before, ["_part", "length"]).withColumn("_total", F.col("_before") + F.col("_rank"))
    return placed.select(*pieces.columns, "_total").mapInArrow(looked_up, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids): the packed sequences themselves, from pieces that kept their ids.

    A group is one sequence, so it is bounded by the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")
    )


def pack(
    docs: DataFrame,
    capacity: Capacity = Capacity(),
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    measure: str = "norm",
    tokenizer: str | None = None,
    end_id: int = 2,
    keep_ids: bool = False,
) -> DataFrame:
    """Cut and place whole documents."""
    return place(cut(docs, capacity.longest(), tokenizer, end_id, keep_ids), capacity, weights, measure)
