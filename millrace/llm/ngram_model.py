"""Scores of texts by an n-gram model held in Elias-Fano tries.

Tokens are words (ASCII letters lower-cased, parted at ASCII white space) and one end for each text. The
model is of order two: the probability of a token after the one before it, by modified Kneser-Ney discounts
interpolated with add-one unigrams, and of the first token after the end. Higher orders are left out since
three quarters of all triples of words occur once (README).

Nothing of the corpus is gathered in one place:

* the vocabulary is counted and numbered by falling count as a table; tasks get only the *steps* (from which
  number on a word has which count), of which there are at most sqrt(2 N);
* a chunk of texts gets the numbers of its own words by a join with the vocabulary, and sends its pairs of
  words to the shards of their contexts, packed, each pair once with the documents that hold it;
* a shard counts the training pairs and writes them down in order; counts of counts of all shards give the
  discounts;
* the shard then writes its trie (a file of compact levels) to the shared folder, maps it into memory, looks all
  pairs up in it and sends sums for each document back.

The number of shards follows the number of tokens. A context that holds a large part of all tokens is *heavy*:
it is cut by the number of the word into ``PARTS`` contexts, which lie in several shards. There are at most
``HEAVY`` times as many heavy contexts as shards; the discount mass of each is summed over its parts and told to
all tasks, so that neither cuts nor shards change a probability (a shard's codebooks round it).

Null texts are empty: one end token. A null id is never held out. Every row is a text of its own whatever its
id. Without any training text all words are unknown. An empty table gives no rows; other columns are ignored.
Chunks are written once and read by every pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import give_back, hashes, mixed, sliced, spread, texts_of, words_of
from millrace.llm.elias_fano import Trie
from millrace.llm.seekable import opened
from millrace.scratch import drop, new_path, remove, written

CHUNK_BYTES, SHARD_TOKENS, PARTS, HEAVY = 16 << 20, 2_000_000, 64, 8
END = 0  # code of the end token in a chunk
ROW = "chunk long, file string, words binary, counts binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or doubles in one compressed blob, each as narrow as its largest value allows.

    All lowest bytes come first, then all second ones and so on: high bytes differ little and compress well.
    """
    narrow = []
    for values in arrays:
        if values.dtype.kind != "f":
            top = int(values.max()) if len(values) else 0
            values = values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<i4" if top < 1 << 31 else "<u8", copy=False)
        narrow.append(np.ascontiguousarray(values))
    heads = [f"{v.dtype.str}:{len(v)};".encode() for v in narrow]
    out = zstandard.ZstdCompressor(level=1).compressobj(size=sum(map(len, heads)) + sum(v.nbytes for v in narrow))
    blob = []
    for head, values in zip(heads, narrow):
        blob.append(out.compress(head))
        blob += [out.compress(values.view(np.uint8)[k :: values.itemsize].tobytes()) for k in range(values.itemsize)]
    return b"".join([*blob, out.flush()])


def unpacked(blob: bytes | np.ndarray, narrow: int = 2) -> list[np.ndarray]:
    """The arrays of :func:`packed`; whole numbers that took ``narrow`` bytes at most come in 32 bits, others in 64."""
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        cut = data.index(b";", at)
        kind, count = data[at:cut].decode().split(":")
        values = np.empty(int(count), np.dtype(kind))
        planes = values.view(np.uint8).reshape(len(values), values.itemsize)
        for k in range(values.itemsize):
            planes[:, k] = np.frombuffer(data, np.uint8, len(values), cut + 1 + k * len(values))
        at = cut + 1 + values.nbytes
        out.append(values if values.dtype.kind == "f" else values.astype(np.int32 if values.itemsize <= narrow else np.int64, copy=False))
    return out


def rises(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values that rise in every run, as the first of each run and the steps after it; ``first`` has the runs' places."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def risen(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of :func:`rises`, from the sizes of the runs."""
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    sums -= np.repeat(sums[first] - steps[first], sizes)
    return sums


def kept(folder: str, name: str, data: bytes) -> str:
    """The path of a new file of the shared folder with these bytes."""
    fs, inner = opened(folder)
    fs.create_dir(inner, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{inner}/{file}", compression=None) as stream:
        stream.write(data)
    return f"{folder}/{file}"


def coded_words(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, the distinct words in order of their first place, words per text), coded a few texts at a time."""
    coded, sizes = [], []
    for some in sliced(iter([batch])):
        words, offsets = words_of(texts_of(some), pc.ascii_lower)
        coded.append(pc.dictionary_encode(words))
        sizes.append(np.diff(offsets))
        del words
    parts = pa.chunked_array(coded).unify_dictionaries().chunks
    return np.concatenate([p.indices.to_numpy() for p in parts]), parts[0].dictionary, np.concatenate(sizes)


def chunk_of(batch: pa.RecordBatch, chunk: int, folder: str) -> pa.RecordBatch:
    """The row of a chunk. What is freed here is gone before the next chunk is begun."""
    codes, distinct, sizes = coded_words(batch)
    give_back()
    held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32) + 1
    sizes = sizes + 1
    tokens = np.zeros(int(sizes.sum()), np.int32)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = rank[codes]
    del codes, rank, inner
    learned, counts = np.repeat(~held, sizes), np.zeros(len(order) + 1, np.int64)
    for a in range(0, len(tokens), 1 << 20):  # counting widens what it counts
        counts += np.bincount(tokens[a : a + (1 << 20)][learned[a : a + (1 << 20)]], minlength=len(order) + 1)
    names = [hashes(distinct.slice(a, 1 << 16)) for a in range(0, len(order), 1 << 16)]
    # the end token is known by a number no word is likely to have
    names = np.concatenate([np.zeros(1, np.uint64), np.concatenate([np.zeros(0, np.uint64), *names])[order]])
    ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    null = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    file = kept(folder, f"texts-{chunk}", packed(sizes, tokens, ids, null, held.astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk], pa.int64()), pa.array([file], pa.string()), pa.array([names.tobytes()], pa.binary()),
            pa.array([counts.astype("<u4").tobytes()], pa.binary()),
        ],
        ["chunk", "file", "words", "counts"],
    )


def chunks(docs: DataFrame, is_held_out: Column, folder: str) -> DataFrame:
    """A row for each chunk of texts: a file in ``folder`` with their tokens as codes of the chunk's own words, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(sliced(batches, limit=CHUNK_BYTES)):
            yield chunk_of(batch, (part << 33) + number, folder)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out.alias("held"), "text")
    return rows.mapInArrow(run, ROW)


def words_in(rows: DataFrame) -> DataFrame:
    """(hash, chunk, at, n): each chunk's own words with their code there and their count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                names = np.frombuffer(words, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names), pa.array(np.full(len(names), chunk)), pa.array(np.arange(len(names), dtype=np.int32)),
                        pa.array(np.frombuffer(counts, "<u4").astype(np.int64)),
                    ],
                    ["hash", "chunk", "at", "n"],
                )

    return rows.select("chunk", "words", "counts").mapInArrow(run, "hash long, chunk long, at int, n long")


@dataclass(frozen=True)
class Counts:
    """What tasks know of the vocabulary: words numbered ``first[i]`` up to the next step have ``count[i]``."""

    first: np.ndarray
    count: np.ndarray
    tokens: int
    words: int
    heavy: int  # words with a smaller number are cut as contexts
    share: np.ndarray  # of unigram mass, for each of PARTS; not used by the model
    shards: int

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Training count of each word number; 0 for unknown words (-1)."""
        if not len(self.first):
            return np.zeros(len(ids), np.int64)
        at = np.searchsorted(self.first, ids, side="right") - 1
        return np.where(ids >= 0, self.count[np.maximum(at, 0)], 0)

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        return (self.of(ids) + 1) / (self.tokens + self.words + 1)

    def context(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Context key of a token: the word before it, and the part of its own number if that word is heavy."""
        part = np.where(ids >= 0, ids % PARTS, 0)
        return before * PARTS + np.where(before < self.heavy, part, 0)


def vocabulary(listed: DataFrame) -> tuple[DataFrame, Counts]:
    """((hash, id) of all training words by falling count, what tasks need to know)."""
    counted = listed.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 0")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                ["hash", "n", "part", "place"],
            )
            at += n

    ordered = counted.repartitionByRange(F.desc("n"), "hash").sortWithinPartitions(F.desc("n"), "hash")
    placed = written(ordered.mapInArrow(numbered, "hash long, n long, part int, place long"), "vocabulary")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = placed.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    ids = placed.join(F.broadcast(starts), "part").select("hash", "n", (F.col("before") + F.col("place")).alias("id"))
    steps = sorted(((r["n"], r["words"]) for r in placed.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    count = np.array([s[0] for s in steps], np.int64)
    many = np.array([s[1] for s in steps], np.int64)
    tokens = int((count * many).sum())
    shards = max(1, -(-tokens // SHARD_TOKENS))
    # as many words can be heavy as there are shards, a few times over
    heavy = int(many[count * shards * HEAVY > tokens].sum())
    known = Counts(np.cumsum(many) - many, count, tokens, total, heavy, np.zeros(0), shards)
    return ids.select("hash", "id"), known


SENT = "shard long, chunk long, data binary"


def pairs_sent(rows: DataFrame, numbers: DataFrame, known: Counts) -> DataFrame:
    """Each chunk's pairs of words, packed for their shards; and, under shards below 0, what it knows itself."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sizes, tokens, listed, null, held = unpacked(mapped(left["file"].iloc[0]), narrow=4)
        # numbers as narrow as they fit: a chunk has millions of tokens
        ids = np.full(int(tokens.max(initial=0)) + 1, -1, np.int32 if known.words < 1 << 31 else np.int64)
        ids[right["at"].to_numpy()] = right["id"].to_numpy()
        end, of_word = ids[END], np.log10(known.unigram(ids))
        word = ids[tokens]
        first = np.cumsum(sizes) - sizes
        before = np.concatenate([ids[END : END + 1], word[:-1]])
        before[first] = end
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        unigram = of_word[tokens]
        base = np.add.reduceat(unigram, first)
        seen = np.add.reduceat(word >= 0, first, dtype=np.int64)
        alone = before < 0  # after an unknown word only the unigram is known
        own = np.bincount(doc[alone], unigram[alone], len(sizes)).astype(np.float64)
        del unigram, tokens
        chunk = int(key[0])
        out = [(-1 - chunk, chunk, packed(listed.astype(np.int64).view(np.uint64), null, held, sizes, seen, base, own))]
        word = word[~alone]
        doc = doc[~alone]
        before = before[~alone]
        del alone
        shard = np.empty(len(word), np.int16 if known.shards < 1 << 15 else np.int32)
        for a in range(0, len(word), 1 << 18):
            some = slice(a, a + (1 << 18))
            shard[some] = mixed(known.context(before[some].astype(np.int64), word[some])) % np.uint64(known.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.cumsum(np.bincount(shard, minlength=known.shards))
        del shard
        for number, (a, b) in enumerate(zip([0, *edges[:-1].tolist()], edges.tolist())):
            if b > a:
                mine = order[a:b]
                w, d = word[mine], doc[mine]
                c = known.context(before[mine].astype(np.int64), w)
                sort = np.lexsort((w, c))  # a stable one: documents stay in order
                c, w, d = c[sort], w[sort], d[sort]
                new = np.concatenate([[True], (np.diff(c) != 0) | (np.diff(w) != 0)])
                at = np.flatnonzero(new | np.concatenate([[True], np.diff(d) != 0]))
                times = np.diff(np.append(at, len(d)))
                c, w, d = c[at], w[at], d[at]
                pair = np.flatnonzero(new[at])
                head = np.flatnonzero(np.concatenate([[True], np.diff(c[pair]) != 0]))
                blob = packed(
                    rises(c[pair][head], head[:1]), np.diff(np.append(head, len(pair))), rises(w[pair] + 1, head),
                    np.diff(np.append(pair, len(at))), rises(d, pair), times, held,
                )
                out.append((number, chunk, blob))
        del word, doc, before, order
        give_back()
        return pd.DataFrame(out, columns=["shard", "chunk", "data"])

    mine = rows.select("chunk", "file")
    return mine.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInPandas(run, SENT)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of pairs seen once, twice, more often, from the counts of pairs."""
    return discounts_of([float((counts == k).sum()) for k in range(1, 5)])


def discounts_of(n: list[float]) -> np.ndarray:
    """As :func:`discounts`, from the numbers of pairs seen once to four times."""
    if min(n[:2]) == 0:
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in range(3)]
    return np.clip(raw, [0.05, 0.1, 0.1], [0.98, 1.9, 2.9])


@dataclass(frozen=True)
class Model:
    """What tasks know of the pairs of all shards: discounts, and the back-off weight of each heavy word."""

    cut: np.ndarray
    weight: np.ndarray


def tallied(context: np.ndarray, count: np.ndarray, known: Counts) -> np.ndarray:
    """Rows (word, n1, n2, n3, n4): pairs of a count of 1 to 4 in all (word -1); pairs of heavy words, n3 with all above."""
    word = context // PARTS
    own = word < known.heavy
    kinds = np.bincount(word[own] * 3 + np.minimum(count[own], 3) - 1, minlength=3 * known.heavy).reshape(-1, 3)
    at = np.flatnonzero(kinds.any(axis=1))
    rows = np.zeros((len(at) + 1, 5), np.int64)
    rows[0] = [-1, *[(count == k).sum() for k in range(1, 5)]]
    rows[1:, 0], rows[1:, 1:4] = at, kinds[at]
    return rows


def model_of(tallies: list[tuple], known: Counts) -> Model:
    """The model from the sums of :func:`tallied` over all shards."""
    sums = {int(t[0]): [float(x) for x in t[1:]] for t in tallies}
    cut = discounts_of(sums.get(-1, [0.0] * 4))
    kinds = np.array([sums.get(w, [0.0] * 4)[:3] for w in range(known.heavy)]).reshape(-1, 3)
    return Model(cut, kinds @ cut / np.maximum(known.of(np.arange(known.heavy)), 1))


def trie_of(context: np.ndarray, word: np.ndarray, count: np.ndarray, known: Counts, model: Model | None = None) -> bytes:
    """The trie of sorted training pairs; probabilities are those of the interpolated model.

    Without a model the pairs are all there are.
    """
    model = model_of(tallied(context, count, known).tolist(), known) if model is None else model
    cut = model.cut[np.minimum(count, 3) - 1]
    head = np.flatnonzero(np.concatenate([[True], np.diff(context) != 0])) if len(context) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(context)))
    before = context[head] // PARTS
    total = known.of(before).astype(np.float64)
    weight = (np.add.reduceat(cut, head) if len(head) else np.zeros(0)) / total
    heavy = before < known.heavy
    weight[heavy] = model.weight[before[heavy]]
    probability = (count - cut) / np.repeat(total, sizes) + np.repeat(weight, sizes) * known.unigram(word)
    return Trie.build(context[head], sizes, word, np.log10(probability), np.log10(weight))


def mapped(uri: str) -> np.ndarray:
    """The bytes of a shared file, memory-mapped where it is a mounted one."""
    fs, inner = opened(uri)
    if type(fs).__name__ == "LocalFileSystem":
        return np.memmap(inner, np.uint8, "r")
    with fs.open_input_file(inner) as file:
        return np.frombuffer(file.read(), np.uint8)


COUNTED = "shard long, chunk long, data binary, held_by binary, tally binary"


def shards_counted(sent: DataFrame, known: Counts) -> DataFrame:
    """A row for each shard: its pairs in order with their training counts, the documents that hold them, and their tally."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        if shard < 0:
            return rows.assign(held_by=None, tally=None)
        context, word, doc, times, learned, chunk = [], [], [], [], [], []
        listed = rows["chunk"].to_numpy()
        for k, blob in enumerate(rows["data"]):
            keys, sizes, words, docs, of, n, held = unpacked(blob, narrow=4)
            of = risen(of, docs).astype(np.int32)
            context.append(np.repeat(np.repeat(np.cumsum(keys, dtype=np.int64), sizes), docs))
            word.append(np.repeat((risen(words, sizes) - 1).astype(np.int32 if known.words < 1 << 31 else np.int64), docs))
            doc.append(of)
            times.append(n)
            learned.append(held[of] == 0)
            chunk.append(np.full(len(of), k, np.int16 if len(listed) < 1 << 15 else np.int32))
        # one column at a time: old and new rows of all of them would not fit beside each other
        context = np.concatenate(context)
        word = np.concatenate(word)
        order = np.lexsort((word, context))
        context = context[order]
        word = word[order]
        doc = np.concatenate(doc)[order]
        times = np.concatenate(times)[order]
        learned = np.concatenate(learned)[order]
        chunk = np.concatenate(chunk)[order]
        del order
        at = np.flatnonzero(np.concatenate([[True], (np.diff(context) != 0) | (np.diff(word) != 0)]))
        count = np.add.reduceat(times * learned, at).astype(np.int64)
        c, w = context[at], word[at].astype(np.int64)
        docs = np.diff(np.append(at, len(context)))
        del context, word, learned
        head = np.flatnonzero(np.concatenate([[True], np.diff(c) != 0]))
        tally = tallied(c[count > 0], count[count > 0], known)
        pairs = packed(rises(c[head], head[:1]), np.diff(np.append(head, len(c))), rises(w + 1, head), count)
        del c, w, count
        held_by = packed(listed.view(np.uint64), docs, doc, times, chunk)
        del docs, doc, times, chunk
        give_back()
        return pd.DataFrame(
            {"shard": [shard], "chunk": [-1], "data": [pairs], "held_by": [held_by], "tally": [tally.astype("<i8").tobytes()]}
        )

    return sent.groupBy("shard").applyInPandas(run, COUNTED)


def tallies(counted: DataFrame) -> list[tuple]:
    """The tallies of all shards, added up: one row for all pairs, one for each heavy word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = np.frombuffer(blob, "<i8").reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], ["word", "n1", "n2", "n3", "n4"])

    listed = counted.where("shard >= 0").select("tally").mapInArrow(run, "word long, n1 long, n2 long, n3 long, n4 long")
    names = ["n1", "n2", "n3", "n4"]
    return [tuple(r) for r in listed.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).collect()]


RETURNED = "chunk long, kind int, data binary"


def shards_scored(counted: DataFrame, known: Counts, model: Model, folder: str) -> DataFrame:
    """Learn and answer: a trie for each shard in ``folder``, and sums for the documents of each chunk."""

    def pairs_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, sizes, words, count = unpacked(data, narrow=4)
        words = (risen(words, sizes) - 1).astype(np.int32 if known.words < 1 << 31 else np.int64)
        return np.repeat(np.cumsum(keys, dtype=np.int64), sizes), words, count

    def learned(shard: int, data: bytes) -> str:
        """The file of a shard's trie."""
        c, w, count = pairs_of(data)
        seen = count > 0
        c = c[seen]
        w = w[seen]
        count = count[seen]
        return kept(folder, f"trie-{shard:08d}", trie_of(c, w, count, known, model))

    def score_of(file: str, data: bytes) -> np.ndarray:
        """Score of each pair of a shard, looked up a part at a time."""
        trie, (c, w, _) = Trie.over(mapped(file)), pairs_of(data)
        score = np.empty(len(c))
        for a in range(0, len(c), 1 << 16):
            some = slice(a, a + (1 << 16))
            there, log, weight = trie.find(c[some], w[some])
            heavy = c[some] // PARTS < known.heavy
            # a part without a training pair is no context of the trie, but its word is
            weight[heavy] = np.log10(model.weight[c[some][heavy] // PARTS])
            unigram = np.log10(known.unigram(w[some]))
            score[some] = np.where(there, log, np.where(np.isnan(weight), unigram, weight + unigram))
        return score

    def answered(shard: int, data: bytes, held_by: bytes) -> pa.RecordBatch:
        # pairs are unpacked for the trie and again for the look-up: both at once would not fit beside each other
        file = learned(shard, data)
        give_back()
        score = score_of(file, data)
        listed, docs, doc, times, chunk = unpacked(held_by, narrow=4)
        of_row = times * np.repeat(score, docs)
        del times, score
        order = np.argsort(chunk, kind="stable")
        doc = doc[order]
        of_row = of_row[order]
        edges = np.searchsorted(chunk[order], np.arange(len(listed) + 1))
        del order, chunk
        out = []
        for k in range(len(listed)):
            mine = slice(edges[k], edges[k + 1])
            sums = np.bincount(doc[mine], of_row[mine]).astype(np.float64)
            texts = np.flatnonzero(np.bincount(doc[mine]))
            out.append(packed(texts, sums[texts]))
        return _returned(listed, 1, pa.array(out, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, chunk = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if shard < 0:
                    yield _returned(np.array([chunk]), 0, batch.column(2).slice(k, 1))
                else:
                    yield answered(shard, batch.column(2)[k].as_py(), batch.column(3)[k].as_py())
                    give_back()

    return counted.select("shard", "chunk", "data", "held_by").mapInArrow(run, RETURNED)


def _returned(chunks_: np.ndarray, kind: int, data: pa.Array) -> pa.RecordBatch:
    kinds = np.full(len(chunks_), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(chunks_.astype(np.int64)), pa.array(kinds), data], ["chunk", "kind", "data"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, is_held_out: Column) -> DataFrame:
    """One row for each text: token counts, the unigram score and the model's score (log10)."""
    folder = new_path(docs.sparkSession, "texts")
    rows = written(chunks(docs, is_held_out, folder), "chunks")
    listed = words_in(rows)
    ids, known = vocabulary(listed)
    numbers = listed.select("hash", "chunk", "at").join(ids, "hash").select("chunk", "at", "id")
    sent = pairs_sent(rows, numbers, known)
    counted = written(shards_counted(sent, known), "pairs")
    drop(rows)  # the shards hold all that is asked of the texts from here on
    remove(docs.sparkSession, folder)
    model = model_of(tallies(counted), known)
    back = shards_scored(counted, known, model, new_path(docs.sparkSession, "tries"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == 0]["data"].iloc[0]
        ids, null, held, sizes, seen, base, score = unpacked(own)
        total = score.copy()
        # the order of arrival must not change the sum
        parts = sorted(rows[rows["kind"] == 1]["data"])
        for blob in parts:
            at, sums = unpacked(blob)
            total[at] += sums
        return pd.DataFrame(
            {
                "doc_id": pd.Series(ids).where(null == 0).astype("Int64"), "held_out": held == 1, "n_tokens": sizes,
                "n_known": seen, "train_tokens": known.tokens, "base_score": base, "score": total,
            }
        )

    return back.groupBy("chunk").applyInPandas(run, SCORES)


def is_held_out(doc_id: Column) -> Column:
    """Texts that teach nothing: those whose crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
