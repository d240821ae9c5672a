"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A tile is a run of at least ``least`` words that a document
and a test item share. Shared runs of that length (seeds) are found by joining running Karp-Rabin hashes of
both sides; seeds on one diagonal grow into maximal matches; the longest match is marked, then the longest of
what is left, and so on, no word being in two tiles. An item's coverage is the share of its words in tiles, so
that passages in another order count as fully as whole ones. A document is contaminated by an item if the
coverage reaches ``threshold``.

The test items are collected if their texts take at most ``block_bytes`` and are gone through in
as many blocks of that size as needed otherwise; documents are never shuffled, so an item that a third of
them quote makes no hot group.

Null and empty texts hold no tiles. Items of fewer words than ``least`` are sought as wholes; items without a
word are never found. Ids may be null or repeated (every pair of rows is judged); ties between equally long
matches go to the earlier place in the document, then in the item. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import coded, hashes, sliced, texts_of, words_of

LEAST, THRESHOLD, BLOCK_BYTES = 5, 0.5, 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

PAIR = "item_id long, tiles int, longest int, matched int, item_words int, coverage double"


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, offsets per text)."""
    words, offsets = words_of(pc.replace_substring_regex(texts, r"[^\pL\pN]+", " "))
    codes, distinct = coded(words)
    return (hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def running(codes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of k codes, by differences of one running sum modulo 2^64."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(codes) - 1, BASE, np.uint64), dtype=np.uint64)])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(codes) - 1, INVERSE, np.uint64), dtype=np.uint64)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * down, dtype=np.uint64)])
        return (sums[k:] - sums[:-k]) * up[: len(codes) - k + 1]


def within(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether the run of k at each place stays in its text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return (np.arange(total) + k <= ends)[: max(total - k + 1, 0)]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, words)."""
    k = min(least, len(item))
    if not k or len(doc) < k:
        return []
    mine, other = running(doc, k), running(item, k)
    order = np.argsort(other, kind="stable")
    low = np.searchsorted(other[order], mine, side="left")
    many = np.searchsorted(other[order], mine, side="right") - low
    at = np.repeat(np.arange(len(mine)), many)
    slot = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    to = order[slot] if len(slot) else slot
    diagonal = at - to
    by = np.lexsort((at, diagonal))
    at, to, diagonal = at[by], to[by], diagonal[by]
    if not len(at):
        return []
    fresh = np.concatenate([[True], (np.diff(diagonal) != 0) | (np.diff(at) != 1)])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(at))) + k - 1
    heap = []
    for s, size in zip(starts.tolist(), sizes.tolist()):
        same = doc[at[s] : at[s] + size] == item[to[s] : to[s] + size]
        _push(heap, int(at[s]), int(to[s]), same, k)
    in_doc, in_item, found = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        size, a, b = heapq.heappop(heap)
        free = ~(in_doc[a : a - size] | in_item[b : b - size])
        if free.all():
            in_doc[a : a - size] = in_item[b : b - size] = True
            found.append((a, b, -size))
        else:
            _push(heap, a, b, free, k)
    return found


def _push(heap: list, a: int, b: int, good: np.ndarray, k: int) -> None:
    """Put the runs of at least k good places on the heap, longest first."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if end - begin >= k:
            heapq.heappush(heap, (begin - end, a + begin, b + begin))


class Items:
    """Test items with an index of their seeds; small enough to go to every task."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        codes, offsets = tokens_of(pc.fill_null(pa.array(texts, pa.string()), ""))
        self.ids, self.least = ids, least
        self.codes = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list] = {}
        for i, words in enumerate(self.codes):
            if len(words):
                k = min(least, len(words))
                by_size.setdefault(k, []).append((running(words, k), i))
        for k, parts in by_size.items():
            seeds = np.concatenate([p for p, _ in parts])
            owner = np.repeat([i for _, i in parts], [len(p) for p, _ in parts])
            order = np.argsort(seeds, kind="stable")
            self.seeds[k] = seeds[order], owner[order]

    def met(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) that share a seed."""
        found = [np.zeros((0, 2), np.int64)]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for k, (seeds, owner) in self.seeds.items():
            mine = running(codes, k)
            low = np.searchsorted(seeds, mine, side="left")
            hit = np.flatnonzero((low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == mine) & within(offsets, k, len(codes)))
            high = np.searchsorted(seeds, mine[hit], side="right")
            many = high - low[hit]
            slot = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append(np.unique(np.stack([np.repeat(rows[hit], many), owner[slot]], axis=1), axis=0))
        return [tuple(p) for p in np.concatenate(found).tolist()]

    def judged(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]], float]]:
        """(text, item, tiles, coverage) of every text and item that share a seed."""
        codes, offsets = tokens_of(texts)
        for text, item in self.met(codes, offsets):
            own = tiles(codes[offsets[text] : offsets[text + 1]], self.codes[item], self.least)
            yield text, item, own, sum(t[2] for t in own) / len(self.codes[item])


def blocks(items: DataFrame, least: int, block_bytes: int) -> list[Items]:
    """The items in blocks of about ``block_bytes`` of text each; one block for any usual benchmark."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    out = []
    for b in range(count):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(count)) == b) if count > 1 else texts
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        out.append(Items([r[0] for r in rows], [r[1] for r in rows], least))
    return out


def contamination(
    docs: DataFrame, items: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each document and item with enough coverage: ids, number of tiles, words matched, coverage."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")

    def judge(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                names = batch.column(batch.schema.get_field_index("doc_id"))
                found = [j for j in block.judged(texts_of(batch)) if j[3] >= threshold]
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array([j[0] for j in found], pa.int64())),
                        pa.array([block.ids[j[1]] for j in found], pa.int64()),
                        pa.array([len(j[2]) for j in found], pa.int32()),
                        pa.array([max((t[2] for t in j[2]), default=0) for j in found], pa.int32()),
                        pa.array([sum(t[2] for t in j[2]) for j in found], pa.int32()),
                        pa.array([len(block.codes[j[1]]) for j in found], pa.int32()),
                        pa.array([j[3] for j in found], pa.float64()),
                    ],
                    ["doc_id", "item_id", "tiles", "longest", "matched", "item_words", "coverage"],
                )

        return rows.mapInArrow(run, f"doc_id {kind}, {PAIR}")

    parts = [judge(block) for block in blocks(items, least, block_bytes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean_documents(
    docs: DataFrame, items: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    out = docs
    for block in blocks(items, least, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                good = np.ones(batch.num_rows, bool)
                good[[j[0] for j in block.judged(texts_of(batch)) if j[3] >= threshold]] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out
