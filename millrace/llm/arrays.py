"""Small helpers on Arrow and numpy arrays that several operators share inside their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in slices of about this many bytes, whatever the size of a Spark batch.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Hand freed memory back to the system: a worker waits for the next task with all that it has ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as a string array, null texts as empty ones."""
    values = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(values.cast(pa.string()), "")


def sliced(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            yield batch.slice(begin, end - begin)
            give_back()


def list_parts(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values, offsets) of a list array, offsets starting at 0."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each value, the distinct values)."""
    if not len(values):
        return np.zeros(0, np.int64), values
    found = pc.dictionary_encode(values)
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... (lengths[i] of them), for all i in turn."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def words_of(texts: pa.Array, lower: Callable = pc.utf8_lower) -> tuple[pa.Array, np.ndarray]:
    """(all words, offsets per text): lower-cased, parted at ASCII white space."""
    words, offsets = list_parts(pc.ascii_split_whitespace(lower(texts)))
    filled = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
    if filled.all():
        return words, offsets
    kept = np.concatenate([[0], np.cumsum(filled)])
    return words.filter(pa.array(filled)), kept[offsets]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that near values get unrelated results."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngram_hashes(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words, offsets per text); a text of 1 to n-1 words has one run of all its words.

    ``codes`` are 64-bit hashes of the words.
    """
    counts = np.diff(offsets)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = spread(runs, offsets[:-1])
    left = np.repeat(offsets[1:], runs) - starts
    with np.errstate(over="ignore"):
        out = np.repeat(np.minimum(counts, n).astype(np.uint64), runs)
        for k in range(n):
            inside = left > k
            word = codes[np.where(inside, starts + k, starts)] if len(codes) else codes
            out = np.where(inside, mixed(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
    return out, np.concatenate([[0], np.cumsum(runs)])
