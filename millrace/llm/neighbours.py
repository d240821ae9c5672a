"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to length one, padded to a power of two and turned by a pseudo-rotation (three rounds of
random signs and a fast Hadamard transform); its hash is the signed axis it is nearest to. A table uses one
such hash, or two side by side once buckets would get long. Every row is in every table once; a query probes, in each
table, the buckets of its best axes in turn. Rows of a bucket and the queries that probe it meet in one
group, where cosines are computed exactly in double precision on the original vectors and only the best few
of each query go on.

The number of probes is fitted: for at most ``SAMPLE`` queries the true neighbours are found by going through
all rows, and the fewest probes that find ``recall`` of them are used. A bucket with many rows is cut into
blocks and its queries into parts that each meet on their own, so that no group grows with the data, whatever the ids. Queries that find too
few rows go through all rows in blocks, which is exact.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a
null id. Vectors of different lengths have no cosine and never meet. Rows of one id count as one: the score of
a pair of ids is the largest. Ties go to the smaller id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import list_parts
from millrace.scratch import written

TABLES, SAMPLE, RECALL, LONG_BUCKET = 8, 128, 0.96, 1 << 16
BLOCK_ROWS, LEAST_BLOCK, MOST_BROADCAST = 16_384, 512, 500_000
CELLS, GATHERED = 1 << 20, 1 << 21  # at once: pairs of a query and a row, components of vectors scored exactly
SLACK = 1e-9
ALL = -1  # the table in which everything is in one bucket

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(good).where(some)


def rows_of(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length of vector."""
    values, offsets = list_parts(lists)
    flat, sizes = values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[(offsets[at][:, None] + np.arange(size))]


def turned(rows: np.ndarray, table: int, part: int) -> np.ndarray:
    """The pseudo-rotation of hash ``part`` of a table on unit vectors."""
    peak = np.abs(rows).max(axis=1, keepdims=True)
    unit = rows / peak
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    width = 1 << max(rows.shape[1] - 1, 1).bit_length()
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = unit
    signs = np.random.default_rng([17, table, part, width]).choice([-1.0, 1.0], (3, width))
    for sign in signs:
        out *= sign
        step = 1
        while step < width:
            pairs = out.reshape(len(rows), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def axes(rows: np.ndarray, table: int, parts: int) -> np.ndarray:
    """How near each row is to every bucket of a table, one column a bucket (larger is nearer)."""
    out = None
    for part in range(parts):
        turn = turned(rows, table, part)
        near = np.concatenate([turn, -turn], axis=1)
        out = near if out is None else (out[:, :, None] + near[:, None, :]).reshape(len(rows), -1)
    return out


def bucket(rows: np.ndarray, table: int, parts: int) -> np.ndarray:
    """The bucket of each row."""
    code = np.zeros(len(rows), np.int64)
    for part in range(parts):
        turn = turned(rows, table, part)
        near = np.concatenate([turn, -turn], axis=1)
        code = code * near.shape[1] + near.argmax(axis=1)
    return code


def named(code: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers that differ between lengths of vectors."""
    return (np.int64(length) << 40) + code


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; alike rows give alike results."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query ids, ids, cosines) of the k nearest ids of each query, its own id left out.

    Rows of one id are one candidate before the cut to k: its score is the largest of its rows.
    """
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    scale = lambda x: x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sizes = np.diff(np.append(start, len(ids)))
    unit, units = scale(queries), scale(rows)
    step, some = max(1, CELLS // len(rows)), max(1, GATHERED // rows.shape[1])
    out = []
    for at in range(0, len(queries), step):
        table = unit[at : at + step] @ units.T
        names = q_ids[at : at + step]
        table[names[:, None] == ids[None, :]] = -np.inf
        tops = np.maximum.reduceat(table, start, axis=1)
        if tops.shape[1] > k:
            least = np.partition(tops, -k, axis=1)[:, -k][:, None]
        else:
            least = np.full((len(tops), 1), -2.0)
        # of each id that may be among the k, the rows that may have its largest score
        floor = np.where((tops >= least - SLACK) & (tops > -np.inf), tops - SLACK, np.inf)
        q, r = np.nonzero(table >= np.repeat(floor, sizes, axis=1))
        # ties may be as many as there are pairs: vectors are gathered for some of them at a time
        exact = np.empty(len(q))
        for p in range(0, len(q), some):
            exact[p : p + some] = cosines(queries[at + q[p : p + some]], rows[r[p : p + some]])
        order = np.lexsort((-exact, ids[r], q))
        q, r, exact = q[order], r[order], exact[order]
        fresh = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(ids[r]) != 0)])[: len(q)]
        q, r, exact = q[fresh], r[fresh], exact[fresh]
        order = np.lexsort((ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        first = np.searchsorted(q, np.arange(len(names)))
        kept = np.arange(len(q)) - first[q] < k
        out.append((names[q[kept]], ids[r[kept]], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _frame(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _lists(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1]
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


MEETING = "table int, bucket long, id long, vector array<double>"


def listed(rows: DataFrame, tables: int, parts: int, probes: int | None = None) -> DataFrame:
    """A row for each table (and each probe, if given): table, bucket, id, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for at, matrix in rows_of(batch.column(1)):
                    for t in range(tables):
                        if probes is None:
                            yield _frame(
                                [np.full(len(at), t, np.int32), named(bucket(matrix, t, parts), matrix.shape[1]), names[at], _lists(matrix)],
                                ["table", "bucket", "id", "vector"],
                            )
                            continue
                        near = axes(matrix, t, parts)
                        some = min(probes, near.shape[1])
                        chosen = np.argpartition(-near, some - 1, axis=1)[:, :some].ravel()
                        own = np.repeat(np.arange(len(at)), some)
                        yield _frame(
                            [np.full(len(own), t, np.int32), named(chosen, matrix.shape[1]), names[at][own], _lists(matrix[own])],
                            ["table", "bucket", "id", "vector"],
                        )

    return rows.select("id", "vector").mapInArrow(run, MEETING)


def through_all(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries, which go to every task; rows stay where they are."""
    asked = queries.collect()
    groups: dict[int, tuple[list, list]] = {}
    for r in asked:
        ids, vectors = groups.setdefault(len(r["vector"]), ([], []))
        ids.append(r["id"])
        vectors.append(r["vector"])
    held = {size: (np.array(i, np.int64), np.array(v, np.float64)) for size, (i, v) in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, matrix in rows_of(batch.column(1)):
                if matrix.shape[1] in held:
                    ids, vectors = held[matrix.shape[1]]
                    yield _frame(list(best(vectors, ids, matrix, names[at], k)), ["query_id", "vec_id", "score"])

    return ranked(rows.select("id", "vector").mapInArrow(run, FOUND), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fitted_probes(queries: DataFrame, rows: DataFrame, tables: int, parts: int, recall: float, k: int) -> int:
    """The fewest probes a table that find ``recall`` of the true neighbours of at most SAMPLE queries."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    near = through_all(sample, rows, k).select("query_id", "vec_id").collect()  # at most SAMPLE * k pairs
    near = rows.sparkSession.createDataFrame(near, "query_id long, vec_id long")
    asked = sample.select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    ids = F.broadcast(near.join(asked, "query_id"))  # at most k rows for each pair of rows of the sample that bear one id
    own = rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("v"))
    own = own.join(F.broadcast(near.select("vec_id").distinct()), "vec_id", "left_semi").distinct()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    unit = lambda a: F.transform(F.col(a), lambda x: x / F.array_max(F.transform(F.col(a), F.abs)))
    met_ = own.join(ids, "vec_id").where(F.size("v") == F.size("q")).withColumn("_v", unit("v")).withColumn("_q", unit("q"))
    cosine = dot(F.col("_v"), F.col("_q")) / F.sqrt(dot(F.col("_v"), F.col("_v")) * dot(F.col("_q"), F.col("_q")))
    # rows of one id count as one, so that the nearest row of a pair of ids stands for it: SAMPLE * k rows at most
    best_rows = met_.groupBy("query_id", "vec_id").agg(F.max(F.struct(cosine.alias("score"), "q", "v")).alias("best"))
    pairs = best_rows.select("best.q", "best.v").collect()
    if not pairs:
        return 1
    needed = []
    for length in {len(p["q"]) for p in pairs}:
        own = [p for p in pairs if len(p["q"]) == length]
        q, v = np.array([p["q"] for p in own]), np.array([p["v"] for p in own])
        least = np.full(len(own), np.iinfo(np.int64).max)
        for t in range(tables):
            near_q, of_v = axes(q, t, parts), bucket(v, t, parts)
            mine = near_q[np.arange(len(own)), of_v][:, None]
            least = np.minimum(least, (near_q > mine).sum(axis=1) + 1)
        needed.append(least)
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1])


def met(queries: DataFrame, index: DataFrame, block_rows: int, k: int) -> DataFrame:
    """The k best of each query in each (table, bucket, block): (query_id, vec_id, score).

    Rows of a long bucket are cut into blocks and its queries into parts; each block meets each part in a group of its own.
    """
    many = lambda df, size, name: (
        df.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
        .select("table", "bucket", F.ceil(F.col("n") / size).cast("int").alias(name))
    )
    cut = written(many(index, block_rows, "blocks").join(many(queries, block_rows, "parts"), ["table", "bucket"], "full"), "long-buckets")
    if cut.count() <= MOST_BROADCAST:
        cut = F.broadcast(cut)
    blocks, parts = F.coalesce("blocks", F.lit(1)), F.coalesce("parts", F.lit(1))
    # rows are dealt by their number in the scan, not by what they hold: copies of one row fall into different blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda n: F.pmod(F.xxhash64("_row"), n).cast("int")
    numbered = lambda df: df.withColumn("_row", F.monotonically_increasing_id()).join(cut, ["table", "bucket"], "left")
    left = numbered(index).withColumn("_block", deal(blocks)).withColumn("_part", every(parts))
    right = numbered(queries).withColumn("_part", deal(parts)).withColumn("_block", every(blocks))
    left, right = (df.withColumn("block", F.col("_block") * parts + F.col("_part")) for df in (left, right))
    shown = ["table", "bucket", "block", "side", "id", "vector"]
    both = right.withColumn("side", F.lit(0)).select(shown).unionByName(left.withColumn("side", F.lit(1)).select(shown))
    dealt = both.repartition("table", "bucket", "block").sortWithinPartitions("table", "bucket", "block", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, q_rows = None, [], []
        for batch in batches:
            table, bucket_, block, side, ids = (
                batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)
            )
            values, offsets = list_parts(batch.column(5))
            flat = values.to_numpy(zero_copy_only=False)
            keys = np.stack([table, bucket_, block, side])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
            out: list[tuple] = []
            for a, b in zip(edges, edges[1:]):
                key = (table[a], bucket_[a], block[a])
                if key != now:
                    now, q_ids, q_rows = key, [], []
                rows = flat[offsets[a] : offsets[b]].reshape(b - a, -1)
                if side[a] == 0:
                    q_ids.append(ids[a:b])
                    q_rows.append(rows)
                elif q_ids:
                    asked, names = np.concatenate(q_rows), np.concatenate(q_ids)
                    for at in range(0, len(asked), 1024):
                        out.append(best(asked[at : at + 1024], names[at : at + 1024], rows, ids[a:b], k))
            if out:
                yield _frame([np.concatenate(c) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    tables: int = TABLES,
    recall: float = RECALL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = usable(vectors, id_column, vector_column)
    queries = rows.where(is_query)
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = 2 << max((size[1] or 1) - 1, 1).bit_length()
    parts = 1 if size[0] <= width * LONG_BUCKET else 2
    probes = fitted_probes(queries, rows, tables, parts, recall, k)
    block = int(min(max(4 * size[0] // width**parts, LEAST_BLOCK), BLOCK_ROWS))
    # written: it is read three times, and rows numbered in a scan are not reused by Spark
    found = written(ranked(met(listed(queries, tables, parts, probes), listed(rows, tables, parts), block, k), k), "neighbours")
    enough = queries.select("id").distinct().join(
        found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left"
    )
    short = enough.where(F.coalesce("n", F.lit(0)) < k).select("id")
    # with fewer found than asked for, all rows are gone through: one bucket, in blocks
    one = lambda df: df.select(F.lit(ALL).alias("table"), F.size("vector").cast("long").alias("bucket"), "id", "vector")
    rest = ranked(met(one(queries.join(short, "id")), one(rows), BLOCK_ROWS, k), k)
    whole = found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
