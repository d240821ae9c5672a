"""Alignment of two tokenizers over the same bytes, and counts of the token pairs that it links.

Tokens are intervals of bytes of a space and the text. All tokens of both sides are sorted by start, ends become
a running maximum, and a *group* breaks where a start reaches it: there a token of each side ends. The tokens
of the two sides in a group are linked, each with each.

Both vocabularies work on each run of non-space characters with the space before it alone (see ``tokens``), so that
the distinct pieces of a chunk of texts are encoded, checked and grouped once, all in one sort, and a
document is the sum of its pieces. Within a group equal ids count as one with a multiplicity, so that links are
never listed one by one.

A chunk keeps a file in the shared folder (codes of its pieces, pairs of ids of each piece) and sends each pair
of ids with its number of documents to the bucket of the A id. Numbers are added up first for ``SALT`` chunks,
then for the bucket, which knows the highest of each A id; the chunk gets back the numbers of its own pairs. Such
rows grow with the chunks, their sums are bounded by pairs of the two vocabularies.

A text whose bytes one side does not give back (a U+2581 in it, for instance), an empty and a null one have
no tokens. Every row is a document of its own, whatever its id; a null id stays null. Strings of special tokens are
ordinary text. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import coded, give_back, list_parts, sliced, spread, texts_of
from millrace.llm.chunks import loaded, range_cuts, rows_of, saved, steps
from millrace.llm.ngram_model import packed, unpacked
from millrace.llm.tokens import ODD, SAFE_CUT, Remembered, encoder_of, vocabulary_path
from millrace.scratch import new_path, written

CHUNK_BYTES = 8 << 20
#: Pairs of ids that meet in one task, and chunks whose numbers are added up first.
PAIRS, SALT = 1 << 20, 64


class ByteSide:
    """A: the byte-level vocabulary."""

    def __init__(self, path: str):
        self.encoder = encoder_of(path)
        words = self.encoder.model.get_vocab()
        # the fixed map of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        names = sorted(words, key=words.get)
        self.tokens = pa.array([bytes(byte.get(c, 0) for c in w) for w in names], pa.binary())
        assert [words[w] for w in names] == list(range(len(names)))

    def encode(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a space and each piece."""
        return self.encoder.pieces(pieces, odd)


class PieceSide:
    """B: the sentencepiece vocabulary, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        single = [self.model.is_byte(k) for k in range(len(names))]
        self.tokens = pa.array([bytes([int(w[3:5], 16)]) if b else w.replace("▁", " ").encode() for w, b in zip(names, single)], pa.binary())

    def encode(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(pieces, num_threads=1)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        return np.fromiter((i for f in found for i in f), np.int64, int(offsets[-1])), offsets


_sides: dict[tuple, tuple] = {}


def sides_of(a: str, b: str) -> tuple[ByteSide, PieceSide, Remembered, Remembered]:
    """The two tokenizers of a worker process and what it remembers of them."""
    if (a, b) not in _sides:
        left, right = ByteSide(a), PieceSide(b)
        _sides[a, b] = left, right, Remembered(left.encode), Remembered(right.encode)
    return _sides[a, b]


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, offsets per text): texts cut where both vocabularies may be cut; each piece follows one space."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
    pieces = pc.split_pattern(texts, " ")
    if not odd.any():
        return list_parts(pieces)
    lists = [SAFE_CUT.split(t) if o else p for t, o, p in zip(texts.to_pylist(), odd, pieces.to_pylist())]
    return list_parts(pa.array(lists, pa.list_(pa.string())))


def _bytes_of(tokens: pa.Array, ids: np.ndarray) -> np.ndarray:
    taken = tokens.take(pa.array(ids))
    return np.frombuffer(taken.buffers()[2] or b"", np.uint8, pc.sum(pc.binary_length(taken)).as_py() or 0)


def gives_back(tokens: pa.Array, ids: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each piece whether its tokens join to its bytes."""
    lengths = pc.binary_length(tokens).to_numpy()
    before = np.concatenate([[0], np.cumsum(lengths[ids])])[offsets]
    same = np.diff(before) == np.diff(ends)
    joined = _bytes_of(tokens, ids)
    size = np.diff(ends)[same]
    unlike = np.zeros(int(size.sum()) + 1, np.int64)
    unlike[1:] = np.cumsum(joined[spread(size, before[:-1][same])] != wanted[spread(size, ends[:-1][same])])
    cuts = np.concatenate([[0], np.cumsum(size)])
    same[same] = np.diff(unlike[cuts]) == 0
    return same


class Groups:
    """The groups of many pieces at once: both sides' tokens as intervals on one line of bytes."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], offsets: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray], starts: np.ndarray):
        begin, end, side, piece, token = [], [], [], [], []
        for k in (0, 1):
            size = lengths[k][ids[k]]
            before = np.concatenate([[0], np.cumsum(size)])
            own = np.repeat(np.arange(len(starts)), np.diff(offsets[k]))
            at = before[:-1] - before[offsets[k][:-1]][own] + starts[own]
            begin.append(at)
            end.append(at + size)
            side.append(np.full(len(at), k))
            piece.append(own)
            token.append(ids[k])
        begin, end, side, piece, token = (np.concatenate(v) for v in (begin, end, side, piece, token))
        order = np.lexsort((side, begin))
        begin, end, self.side, self.piece, self.token = (v[order] for v in (begin, end, side, piece, token))
        reach = np.maximum.accumulate(end) if len(end) else end
        breaks = np.ones(len(begin), bool)
        breaks[1:] = begin[1:] >= reach[:-1]
        self.group = np.cumsum(breaks) - 1
        self.count = int(breaks.sum())
        self.home = self.piece[breaks]  # the piece of each group

    def sizes(self, side: int) -> np.ndarray:
        return np.bincount(self.group[self.side == side], minlength=self.count)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, a * width + b, links): each pair of ids of each piece once."""
        ids, times, ends = [], [], []
        for k in (0, 1):
            own = self.side == k
            key, n = np.unique(self.group[own] << 32 | self.token[own], return_counts=True)
            ids.append(key & 0xFFFFFFFF)
            times.append(n)
            ends.append(np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=self.count))]))
        left = np.repeat(np.arange(self.count), np.diff(ends[0]))  # the group of each A id
        fan = np.diff(ends[1])[left]
        a, b = np.repeat(np.arange(len(left)), fan), spread(fan, ends[1][:-1][left])
        pair = ids[0][a] * width + ids[1][b]
        return summed(self.home[left[a]], pair, times[0][a] * times[1][b])

    def texts(self, decimal: tuple[pa.Array, pa.Array], pieces: int) -> pa.Array:
        """``a1,a2|b1;a3|b2`` of each piece."""
        halves = []
        for k in (0, 1):
            cuts = np.concatenate([[0], np.cumsum(self.sizes(k))])
            names = decimal[k].take(pa.array(self.token[self.side == k]))
            halves.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names), ","))
        both = pc.binary_join_element_wise(*halves, "|")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(self.home, minlength=pieces))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), both), ";")


def summed(first: np.ndarray, second: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, sum of the values) of each distinct pair, in their order."""
    order = np.lexsort((second, first))
    first, second, values = first[order], second[order], values[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    begin = np.flatnonzero(new)
    return first[begin], second[begin], np.add.reduceat(values, begin) if len(begin) else values


def shuffled_ids(count: int) -> np.ndarray:
    """A fixed order of A ids, so that equal ranges of places hold like numbers of frequent ids."""
    return np.random.default_rng(0).permutation(count).astype(np.int64)


CHUNK = "chunk long, path string, pairs long, documents long"


def write_chunks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(chunk, path, pairs, documents): encode and group all texts, a file for each chunk."""
    folder = new_path(docs.sparkSession, "aligned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, limit=CHUNK_BYTES):
            columns = chunk_columns(batch, a, b)
            path = saved(folder, f"chunk-{number}", columns)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (number, path, len(columns["pairs"]), batch.num_rows)], ["chunk", "path", "pairs", "documents"])
            number += 1
            del columns
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, CHUNK), "aligned")


def chunk_columns(batch: pa.RecordBatch, path_a: str, path_b: str) -> dict[str, pa.Array]:
    left, right, remembered_a, remembered_b = sides_of(path_a, path_b)
    texts = texts_of(batch)
    values, offsets = pieces_of(texts)
    codes, distinct = coded(values)
    names = distinct.to_pylist()
    odd = pc.match_substring_regex(distinct, f"{ODD}|^$").to_numpy(zero_copy_only=False).astype(bool)
    ids, ends = zip(*[side(names, odd) for side in (remembered_a, remembered_b)])
    ids = tuple(i.astype(np.int64) for i in ids)
    spaced = pc.binary_join_element_wise("", distinct, " ") if len(distinct) else distinct
    sizes = pc.binary_length(spaced).to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    wanted = _bytes_of(spaced, np.arange(len(names)))
    good = gives_back(left.tokens, ids[0], ends[0], wanted, starts) & gives_back(right.tokens, ids[1], ends[1], wanted, starts)
    for k in (0, 1):  # pieces that are not given back have no tokens here
        kept = np.repeat(good, np.diff(ends[k]))
        counts = np.where(good, np.diff(ends[k]), 0)
        ids, ends = (*ids[:k], ids[k][kept], *ids[k + 1 :]), (*ends[:k], np.concatenate([[0], np.cumsum(counts)]), *ends[k + 1 :])
    lengths = tuple(pc.binary_length(side.tokens).to_numpy().astype(np.int64) for side in (left, right))
    groups = Groups(ids, ends, lengths, starts[:-1])
    width = len(right.tokens)
    place = shuffled_ids(len(left.tokens))
    piece, pair, links = groups.pairs(width)
    pair = place[pair // width] * width + pair % width
    count = len(names)
    of_piece = {
        "n_a": np.diff(ends[0]), "n_b": np.diff(ends[1]), "n_groups": np.bincount(groups.home, minlength=count),
        "n_links": np.bincount(piece, links, minlength=count).astype(np.int64),
    }
    bad = np.concatenate([[0], np.cumsum(~good[codes])])
    whole = (np.diff(bad[offsets]) == 0) & (pc.binary_length(texts).to_numpy() > 0)
    counts = np.where(whole, np.diff(offsets), 0)
    codes = codes[np.repeat(whole, np.diff(offsets))]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    # documents of each pair: distinct pieces of a document, then distinct pairs
    own = np.unique(np.repeat(np.arange(len(texts)), counts) * max(count, 1) + codes)
    document, held = own // max(count, 1), own % max(count, 1)
    distinct_pairs, pair_code = np.unique(pair, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=count))])
    fan = np.diff(first)[held]
    met = np.unique(np.repeat(document, fan) * max(len(distinct_pairs), 1) + pair_code[spread(fan, first[:-1][held])])
    documents = np.bincount(met % max(len(distinct_pairs), 1), minlength=len(distinct_pairs))
    decimal = tuple(pa.array(list(map(str, range(len(side.tokens)))), pa.string()) for side in (left, right))
    out = {
        "ids": batch.column(0), "offsets": pa.array(offsets), "codes": pa.array(codes.astype(np.int32)), "first": pa.array(first.astype(np.int32)),
        "code": pa.array(pair_code.astype(np.int32)), "links": pa.array(links.astype(np.int32)), "pairs": pa.array(distinct_pairs),
        "documents": pa.array(documents.astype(np.int32)), "texts": groups.texts(decimal, count),
    }
    return out | {c: pa.array(v.astype(np.int32)) for c, v in of_piece.items()}


NUMBERS = {"bucket": pa.int32(), "salt": pa.int64(), "chunk": pa.int64(), "path": pa.string(), "data": pa.binary()}
NUMBERS_ROW = "bucket int, salt long, chunk long, path string, data binary"


def numbers_of(manifest: DataFrame, buckets: int, values: int) -> DataFrame:
    """The pairs of each chunk with their documents, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = loaded(row["path"])
                pair, documents = found["pairs"].to_numpy(), found["documents"].to_numpy()
                cuts = range_cuts(pair, values, buckets)
                rows = [(b, row["salt"], row["chunk"], row["path"], packed(steps(pair[i:j]), documents[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                yield rows_of(NUMBERS, rows)

    return manifest.mapInArrow(run, NUMBERS_ROW)


def _added(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, sum of their numbers) of packed rows."""
    each = [unpacked(blob) for blob in blobs]
    pair, inverse = np.unique(np.concatenate([np.cumsum(e[0]) for e in each]), return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, inverse, np.concatenate([e[1] for e in each]))
    return pair, total


def highest(pair: np.ndarray, total: np.ndarray, width: int) -> np.ndarray:
    """Whether each pair's number is the highest of its A id; pairs are sorted."""
    new = np.ones(len(pair), bool)
    new[1:] = (pair // width)[1:] != (pair // width)[:-1]
    return total == np.maximum.reduceat(total, np.flatnonzero(new))[np.cumsum(new) - 1] if len(pair) else new


def totals_of(numbers: DataFrame, width: int) -> DataFrame:
    """(bucket, data): corpus-wide numbers of all pairs of a bucket and whether each is the highest of its A id."""

    def some(group: pa.Table) -> pa.Table:
        pair, total = _added(group["data"].to_pylist())
        return pa.table([group["bucket"].slice(0, 1), pa.array([packed(steps(pair), total)], pa.binary())], ["bucket", "data"])

    def every(group: pa.Table) -> pa.Table:
        pair, total = _added(group["data"].to_pylist())
        data = packed(steps(pair), total, highest(pair, total, width).astype(np.int64))
        return pa.table([group["bucket"].slice(0, 1), pa.array([data], pa.binary())], ["bucket", "data"])

    parts = numbers.groupBy("bucket", "salt").applyInArrow(some, "bucket int, data binary")
    return parts.groupBy("bucket").applyInArrow(every, "bucket int, data binary")


def answers_of(numbers: DataFrame, totals: DataFrame) -> DataFrame:
    """Corpus-wide numbers of the pairs of each row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rises, total, best = unpacked(right["data"][0].as_py())
        pair, data = np.cumsum(rises), []
        for blob in left["data"].to_pylist():
            at = np.searchsorted(pair, np.cumsum(unpacked(blob)[0]))
            data.append(packed(total[at], best[at]))
        return left.set_column(left.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    asked = numbers.select(F.col("bucket").alias("bucket"), F.col("salt").alias("salt")).distinct()
    copies = totals.join(asked, "bucket")
    return numbers.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(run, NUMBERS_ROW)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def documents_of(manifest: DataFrame, answers: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = loaded(left["path"][0].as_py())
        numbers = {c: found[c].to_numpy().astype(np.int64) for c in ("offsets", "codes", "first", "code", "links", "n_a", "n_b", "n_groups", "n_links")}
        rows = [unpacked(r["data"]) for r in sorted(right.select(["bucket", "data"]).to_pylist(), key=lambda r: r["bucket"])]
        total, best = (np.concatenate([np.zeros(0, np.int64), *[r[k].astype(np.int64) for r in rows]]) for k in (0, 1))
        for name, of_pair in (("n_best", best), ("count_sum", total)):
            sums = np.concatenate([[0], np.cumsum(of_pair[numbers["code"]] * numbers["links"])])
            numbers[name] = np.diff(sums[numbers["first"]])
        offsets, codes = numbers["offsets"], numbers["codes"]
        sums = [np.diff(np.concatenate([[0], np.cumsum(numbers[c][codes])])[offsets]) for c in SUMS]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found["texts"].take(pa.array(codes))), ";")
        give_back()
        return pa.table([found["ids"], *map(pa.array, sums), joined], ["doc_id", *SUMS, "groups"])

    return manifest.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ALIGNED)


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row for each document: tokens, groups and links, and what the whole table says of its links.

    ``groups`` has the ids of each group in order, A before B (``a1,a2|b1;a3|b2,b3``); ``n_best`` counts links whose
    pair stands in as many documents as any pair of its A id, ``count_sum`` sums the documents over links.
    """
    a, b = a or vocabulary_path(), b or vocabulary_path("piece_bpe_32k.model")
    left, right, _, _ = sides_of(a, b)
    width, values = len(right.tokens), len(left.tokens) * len(right.tokens)
    manifest = write_chunks(docs, a, b)
    chunks, pairs = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    parts, buckets = max(chunks, 1), pairs // PAIRS + 1
    salt = F.pmod(F.xxhash64("chunk"), F.lit(chunks // SALT + 1)).alias("salt")
    asked = numbers_of(manifest.select("chunk", "path", salt).repartition(parts), buckets, values)
    numbers = written(asked.repartition(buckets * (chunks // SALT + 1), "bucket", "salt"), "pair-numbers")
    totals = written(totals_of(numbers, width), "pair-totals")
    answers = answers_of(numbers, totals)
    return documents_of(manifest.select("chunk", "path").repartition(parts, "chunk"), answers.repartition(parts, "chunk"))


def alignment_digest(docs: DataFrame) -> DataFrame:
    """The groups of each document as their SHA-256; empty without tokens."""
    rows = aligned(docs)
    return rows.select("doc_id", *SUMS, F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
