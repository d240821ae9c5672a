"""Set similarity join by chosen paths: near copies of documents by the Jaccard index of their word shingles.

Documents with one set of shingles are copies and are joined as one set. A set is shown by ``WIDTH`` sampled
tokens: under each of as many hash functions, the token with the smallest value, so that two sets share a
sampled token with a probability equal to their Jaccard index. One run of the join is a tree: at the root and
at every bucket that is still large, ``BRANCH`` of the sampled tokens (which ones depends on the bucket) are
chosen and the sets go to one child for each, together with the sets that have the same token there. Small
buckets are leaves and are compared by brute force. A bucket whose sets are alike on average would not get
smaller; it is a leaf too, compared in blocks. A pair at the threshold survives a run with a fixed
probability at any depth, given how many sampled tokens it shares. Runs choose tokens on their own but from the
same sample, so that :func:`recall_of` averages over the shared number and :func:`runs_for` gives the runs that reach
the target recall: five, which find a pair at the threshold with a probability of 0.99996.

A pair may share several leaves; it is compared only in the smallest of them, so that links are counted, not
listed. A byte of each sampled token serves as a sketch that rules out unlike pairs; all others are compared
exactly, on whole sets. A leaf gives, for each set, its number of links, and edges that connect what is
linked; components of these edges are the classes.

Words are parted at white space and lower-cased; a text of one to four words has one shingle of all of them.
A text without words (null too) is in a class of its own and has no links. Every row is a document: rows of
one id are copies or not like any other two. Null ids are allowed; a class is named by its smallest id. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.graph.frame import Graph
from millrace.graph.loops import connected_components
from millrace.llm.arrays import coded, give_back, hashes, mixed, ngram_hashes, sliced, spread, texts_of, words_of
from millrace.scratch import drop, numbered, written

SHINGLE, LEAST, RECALL = 5, 0.8, 0.9999
WIDTH, BRANCH, LEAF = 64, 2, 128
ALIKE = 1 / BRANCH  # a bucket of such an average similarity does not get smaller by branching
BLOCK_SETS, BLOCK_ITEMS, MOST_BROADCAST = 512, 1 << 20, 1_000_000
ITEM_BITS = 48

_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def survival(least: float = LEAST, branch: int = BRANCH) -> float:
    """Least probability that a pair at the threshold shares a leaf of a run, however deep."""
    s = 1.0
    for _ in range(1000):
        s = 1 - (1 - least * s) ** branch
    return s


def recall_of(runs: int, least: float = LEAST, branch: int = BRANCH) -> float:
    """Probability that a pair at the threshold shares a leaf of some run; all runs choose from one sample of WIDTH tokens."""
    shared = ((k, math.comb(WIDTH, k) * least**k * (1 - least) ** (WIDTH - k)) for k in range(WIDTH + 1))
    return 1 - sum(p * (1 - survival(k / WIDTH, branch)) ** runs for k, p in shared)


def runs_for(recall: float, least: float = LEAST, branch: int = BRANCH) -> int:
    """The fewest runs that reach the recall for a pair at the threshold."""
    runs = 1
    while recall_of(runs, least, branch) < recall:
        runs += 1
        if runs > WIDTH:
            raise ValueError(f"no {WIDTH} runs over {WIDTH} sampled tokens reach a recall of {recall}")
    return runs


def sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text, offsets); a shingle is a hash of 48 bits."""
    words, offsets = words_of(texts)
    codes, distinct = coded(words)
    found, at = ngram_hashes(hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), offsets, shingle)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    shift = np.uint64(ITEM_BITS)
    both = np.unique((rows << shift) | (found >> np.uint64(64 - ITEM_BITS)))
    edges = np.searchsorted(both >> shift, np.arange(len(texts) + 1, dtype=np.uint64))
    return both & np.uint64((1 << ITEM_BITS) - 1), edges


def samples(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest hash of each set under each of WIDTH functions; sets are not empty."""
    out = np.empty((len(offsets) - 1, WIDTH), np.uint32)
    with np.errstate(over="ignore"):
        base = mixed(items)
        for c in range(WIDTH):
            values = ((base * FACTORS[c] + TERMS[c]) >> np.uint64(32)).astype(np.uint32)
            out[:, c] = np.minimum.reduceat(values, offsets[:-1])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def signed(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, first, second, size, sample): a fingerprint and the sampled tokens of every document's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for begin in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(begin, 1 << 15)
                items, offsets = sets_of(texts_of(part), shingle)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes > 0)
                edges = np.append(offsets[:-1][full], offsets[-1])
                first, second = np.zeros((2, part.num_rows), np.int64)
                shown = np.zeros((part.num_rows, WIDTH), np.uint32)
                if len(full):
                    with np.errstate(over="ignore"):
                        first[full] = np.add.reduceat(mixed(items), edges[:-1]).view(np.int64)
                        second[full] = np.add.reduceat(mixed(items * np.uint64(3) + np.uint64(1)), edges[:-1]).view(np.int64)
                    shown[full] = samples(items, edges)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(first), pa.array(second), pa.array(sizes), _binary(shown)],
                    ["row", "doc_id", "first", "second", "size", "sample"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(sign, f"row long, doc_id {kind}, first long, second long, size long, sample binary")


def chosen(keys: np.ndarray, used: np.ndarray, branch: int) -> np.ndarray:
    """The sampled tokens that each bucket branches on, none that its path has used before."""
    out = np.zeros((len(keys), branch), np.int64)
    taken = used.astype(np.uint64)
    for b in range(branch):
        start = (mixed(keys.astype(np.uint64) + np.uint64(b + 1)) % np.uint64(WIDTH)).astype(np.int64)
        for step in range(WIDTH):
            busy = (taken >> start.astype(np.uint64)) & np.uint64(1) == 1
            if not busy.any():
                break
            start[busy] = (start[busy] + 1) % WIDTH
        out[:, b] = start
        taken |= np.uint64(1) << start.astype(np.uint64)
    return out


CHILD = "parent long, n_parent long, bucket long, used long, node long"


def branched(rows: DataFrame, branch: int) -> DataFrame:
    """Rows (bucket, used, n, node, sample) of large buckets in the children of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, used, n, node = (_long(batch.column(i)) for i in range(4))
            sample = _matrix(batch.column(4), "<u4")
            places = chosen(keys, used, branch)
            for b in range(branch):
                token = sample[np.arange(len(keys)), places[:, b]].astype(np.uint64)
                with np.errstate(over="ignore"):
                    child = mixed(mixed(keys.astype(np.uint64) + np.uint64(b + 101)) + token).view(np.int64)
                mask = (used.astype(np.uint64) | (np.uint64(1) << places[:, b].astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (keys, n, child, mask, node)], ["parent", "n_parent", "bucket", "used", "node"]
                )

    return rows.select("bucket", "used", "n", "node", "sample").mapInArrow(run, CHILD)


def leaves_of(sets: DataFrame, runs: int, branch: int = BRANCH, leaf: int = LEAF) -> DataFrame:
    """(bucket, n, node): the leaves of all runs with more than one set, from sets (node, sample)."""
    spark = sets.sparkSession
    total = sets.count()
    roots = spark.createDataFrame([(r,) for r in range(runs)], "run int")
    # a root chooses among its own share of the sampled tokens, so that runs are independent
    share = WIDTH // runs
    free = [((1 << WIDTH) - 1) ^ (((1 << share) - 1) << (r * share)) for r in range(runs)]
    masks = [m - (1 << 64) if m >> 63 else m for m in free]
    seeds = [int(mixed(np.array([r + 7], np.uint64)).view(np.int64)[0]) for r in range(runs)]
    table = F.array(*[F.struct(F.lit(s).alias("bucket"), F.lit(m).alias("used")) for s, m in zip(seeds, masks)])
    level = sets.select("node", "sample", F.explode(table).alias("root")).select(
        "root.bucket", "root.used", F.lit(total).cast("long").alias("n"), "node", "sample"
    )
    done, tables, first = [], [], True
    while True:
        kids = branched(level, branch)
        if first:  # below the root every sampled token is free but the one on the path
            root = F.when(F.lit(False), F.col("used"))
            for s, m in zip(seeds, masks):
                root = root.when(F.col("parent") == s, F.col("used").bitwiseXOR(F.lit(m)))
            kids = kids.withColumn("used", root)
        kids = written(kids, "children")
        counts = kids.groupBy("parent", "n_parent", "bucket").agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts.where("n > 1"), "counts")
        alike = counts.groupBy("parent", "n_parent").agg(
            (F.sum(F.col("n").cast("double") * F.col("n")) / (branch * F.col("n_parent").cast("double") * F.col("n_parent"))).alias("alike")
        ).where((F.col("alike") >= ALIKE) & (F.col("n_parent") > leaf))
        spent = kids.where(F.bit_count("used") >= WIDTH - branch).select("parent", "n_parent").distinct()
        ended = written(alike.select("parent", "n_parent").unionByName(spent).distinct(), "ended")
        if not first:
            done.append(level.join(ended.select(F.col("parent").alias("bucket")), "bucket", "left_semi").select("bucket", "n", "node"))
        shared = kids.join(counts.select("bucket", "n"), "bucket")
        if not first:
            shared = shared.join(ended.select("parent"), "parent", "left_anti")
        shared = written(shared.select("bucket", "used", "n", "node"), "buckets")
        tables += [shared, ended]
        drop(kids)
        drop(counts)
        done.append(shared.where(F.col("n") <= leaf).select("bucket", "n", "node"))
        large = shared.where(F.col("n") > leaf)
        first = False
        if not large.head(1):
            break
        level = large.join(sets.select("node", "sample"), "node").select("bucket", "used", "n", "node", "sample")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    leaves = written(out, "leaves")
    for table in tables:
        drop(table)
    return leaves


def in_blocks(leaves: DataFrame, leaf: int) -> DataFrame:
    """Rows of leaves dealt to pairs of blocks: (bucket, low, high, block); a small leaf is one block.

    A pair of blocks holds a bounded number of sets and of shingles; a set of a large leaf is in as many as
    the leaf has blocks.
    """
    sizes = leaves.groupBy("bucket", "n").agg(F.sum("size").alias("items"))
    by_sets = F.when(F.col("n") <= leaf, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK_SETS))
    blocks = F.greatest(F.ceil(F.col("items") / BLOCK_ITEMS), by_sets).cast("int")
    several = sizes.select("bucket", blocks.alias("blocks")).where("blocks > 1")
    if several.count() <= MOST_BROADCAST:
        several = F.broadcast(several)
    counted = leaves.join(several, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    ).drop("other", "blocks", "n")


GROUP = ["bucket", "low", "high"]


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Groups of rows that follow each other with one (bucket, low, high)."""
    key, held = None, {n: [] for n in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([_long(batch.column(batch.schema.get_field_index(g))) for g in GROUP])
        cuts = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = tuple(marks[:, a].tolist())
            if now != key:
                if key is not None:
                    yield key, held
                key, held = now, {n: [] for n in names}
            for n in names:
                held[n].extend(batch.column(batch.schema.get_field_index(n)).slice(a, b - a).to_pylist())
    if key is not None:
        yield key, held


def likely(key: tuple, held: dict[str, list], least: float) -> np.ndarray:
    """Pairs to compare in a group: sketches alike, sizes near, and in no smaller leaf together (upper triangle)."""
    bucket, low, high = key
    n = len(held["node"])
    node, size = np.array(held["node"], np.int64), np.array(held["size"], np.float64)
    block = np.array(held["block"])
    sketch = np.frombuffer(b"".join(held["sketch"]), np.uint8).reshape(n, WIDTH)
    floor = least * WIDTH - 5 * math.sqrt(WIDTH * least * (1 - least))
    good = np.zeros((n, n), bool)
    for at in range(0, n, 64):
        good[at : at + 64] = (sketch[at : at + 64, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.uint8) >= floor
    good &= np.minimum(size[:, None], size[None, :]) >= least * np.maximum(size[:, None], size[None, :]) - 1e-9
    good &= node[:, None] < node[None, :]
    if low != high:
        good &= block[:, None] != block[None, :]
    rows = np.repeat(np.arange(n), [len(x) for x in held["leaves"]])
    listed = np.array([v for x in held["leaves"] for v in x], np.int64)
    smaller = listed < bucket
    rows, listed = rows[smaller], listed[smaller]
    if len(rows) and good.any():
        _, codes, many = np.unique(listed, return_inverse=True, return_counts=True)
        met = many[codes] > 1
        rows, codes = rows[met], np.unique(codes[met], return_inverse=True)[1]
        if len(rows):
            member = np.zeros((n, int(codes.max()) + 1), np.float32)
            member[rows, codes] = 1
            good &= (member @ member.T) == 0
    return good


def with_partners(dealt: DataFrame, least: float) -> DataFrame:
    """(bucket, low, high, node) of the rows that have a likely partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in groups(batches, ["node", "size", "block", "sketch", "leaves"]):
            good = likely(key, held, least)
            kept = np.array(held["node"], np.int64)[good.any(axis=0) | good.any(axis=1)]
            if len(kept):
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.full(len(kept), k, np.int64)) for k in key], pa.array(kept)], [*GROUP, "node"]
                )
        give_back()

    ordered = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return ordered.mapInArrow(run, "bucket long, low long, high long, node long")


LINK = "node long, root long, texts long, documents long"


def compared(dealt: DataFrame, least: float) -> DataFrame:
    """For each set of each group: its links there, and one set that it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in groups(batches, ["node", "size", "block", "sketch", "leaves", "copies", "items"]):
            node, copies = np.array(held["node"], np.int64), np.array(held["copies"], np.int64)
            n = len(node)
            good = likely(key, held, least)
            sizes = np.array([len(x) // 8 for x in held["items"]], np.int64)
            codes = np.unique(np.frombuffer(b"".join(held["items"]), "<u8"), return_inverse=True)[1]
            starts = np.cumsum(sizes) - sizes
            mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
            links = np.zeros((n, n), bool)
            for a in np.flatnonzero(good.any(axis=1)):
                others = np.flatnonzero(good[a])
                own = codes[starts[a] : starts[a] + sizes[a]]
                mark[own] = True
                for at in range(0, len(others), 64):
                    some = others[at : at + 64]
                    hits = mark[codes[spread(sizes[some], starts[some])]]
                    common = np.add.reduceat(hits, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                    links[a, some] = common >= least * (sizes[a] + sizes[some] - common) - 1e-9
                mark[own] = False
            links |= links.T
            kept = np.flatnonzero(links.any(axis=1))
            root = np.full(n, -1)
            for a in kept:
                if root[a] >= 0:
                    continue
                root[a], front = a, [a]
                while front:
                    near = np.flatnonzero(links[front].any(axis=0) & (root < 0))
                    root[near] = a
                    front = near.tolist()
            if len(kept):
                documents = links[kept].astype(np.float64) @ copies
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (node[kept], node[root[kept]], links[kept].sum(axis=1), documents.astype(np.int64))],
                    ["node", "root", "texts", "documents"],
                )
        give_back()

    ordered = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return ordered.mapInArrow(run, LINK)


def items_of(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of the sets ``wanted`` (row, node): the text of one document of each is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for begin in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(begin, 1 << 15)
                items, offsets = sets_of(texts_of(part), shingle)
                raw = pa.py_buffer(items.astype("<u8").tobytes())
                lists = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "items"])

    few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    return rows.select("row", "text").join(few, "row").select("node", "text").mapInArrow(run, "node long, items binary")


def similar_classes(
    docs: DataFrame, least: float = LEAST, recall: float = RECALL, shingle: int = SHINGLE, leaf: int = LEAF
) -> DataFrame:
    """One row for each document, by number: row, class_no, doc_id, class_id, copy_id, n_texts, n_links.

    ``class_no`` numbers the classes, never null: ids may be null or repeated, so that two classes can have one
    ``class_id``. ``copy_id`` is the smallest id with the same set, ``class_id`` the smallest id of the linked documents,
    ``n_texts`` the number of other sets at least ``least`` alike, ``n_links`` the number of other documents.
    """
    return classes_of(numbered(docs.select("doc_id", "text")), least, recall, shingle, leaf)


def classes_of(
    numbers: DataFrame, least: float = LEAST, recall: float = RECALL, shingle: int = SHINGLE, leaf: int = LEAF
) -> DataFrame:
    """:func:`similar_classes` of a table of :func:`numbered`."""
    rows = numbers.select("row", "doc.doc_id", "doc.text")
    marks = written(signed(rows, shingle), "signed")
    full = marks.where("size > 0")
    sets = full.groupBy("first", "second").agg(
        F.min("row").alias("row"),
        F.min("doc_id").alias("copy_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"),
        F.first("sample").alias("sample"),
    )
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    # the samples take most of the room: what is read later goes without them
    sampled, measured = sets, marks
    marks = written(marks.drop("sample"), "signed")
    full = marks.where("size > 0")
    sets = written(sets.drop("sample"), "sets")
    drop(measured)
    leaves = leaves_of(sampled, runs_for(recall, least), leaf=leaf)
    own = leaves.groupBy("node").agg(F.collect_set("bucket").alias("leaves"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                short = (_matrix(batch.column(3), "<u4") & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(short)], ["node", "size", "copies", "sketch"])

    kind = "node long, size long, copies long, sketch binary"
    short = own.join(sampled.select("node", "size", "copies", "sample"), "node")
    short = written(
        short.select("node", "size", "copies", "sample").mapInArrow(sketched, kind).join(own, "node"), "sketches"
    )
    drop(sampled)
    dealt = in_blocks(leaves.join(short, "node"), leaf)
    kept = written(with_partners(dealt, least), "partners")
    wanted = kept.select("node").distinct().join(sets.select("node", "row"), "node")
    items = items_of(rows, wanted, shingle)
    again = in_blocks(leaves.join(short, "node"), leaf).join(kept, [*GROUP, "node"])
    links = written(compared(again.join(items, "node"), least), "links")
    for table in (leaves, short, kept):
        drop(table)
    counted = links.groupBy("node").agg(F.sum("texts").alias("n_texts"), F.sum("documents").alias("n_others"))
    edges = written(links.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct(), "edges")
    if edges.head(1):
        parts = connected_components(Graph.from_edges(edges)).withColumnRenamed("id", "node")
        named = parts.join(sets.select("node", "copy_id"), "node")
        smallest = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
        classes = written(named.select("node", "component").join(smallest, "component").select("node", F.col("component").alias("class_no"), "class_id"), "classes")
    else:
        classes = sets.select("node", F.col("node").alias("class_no"), F.col("copy_id").alias("class_id")).where(F.lit(False))
    told = (
        sets.select("first", "second", "node", "copy_id", "copies")
        .join(classes, "node", "left")
        .join(counted, "node", "left")
        .select(
            "first", "second", "copy_id",
            # a class of one set has the number of its set; components have the number of one of theirs
            F.coalesce("class_no", "node").alias("class_no"),
            F.when(F.col("class_no").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
            (F.coalesce("n_others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        )
    )
    shown = ["row", "class_no", "doc_id", "class_id", "copy_id", "n_texts", "n_links"]
    nothing = F.lit(0).cast("long")
    alone = marks.where("size = 0").select(
        "row", (-1 - F.col("row")).alias("class_no"), "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), nothing.alias("n_texts"), nothing.alias("n_links")
    )
    return full.select("row", "doc_id", "first", "second").join(told, ["first", "second"]).select(shown).unionByName(alone)


def one_of_each(docs: DataFrame, least: float = LEAST, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest id, all columns kept."""
    marked = numbered(docs)
    classes = written(classes_of(marked, least, recall, shingle), "near-copies")
    alone = classes.where((F.col("n_links") == 0)).select("row")
    kept = classes.where(F.col("n_links") > 0).groupBy("class_no").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("least")
    )
    rows = alone.unionByName(kept.select(F.col("least.row").alias("row")))
    return marked.join(rows, "row", "left_semi").select("doc.*")
