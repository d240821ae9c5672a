"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

A *window* is ``least`` consecutive words of one document. A word goes if it lies in a window whose words also
stand in a document with a smaller id. Windows are judged on the texts as given.

The texts are written once as *chunks*: a file each in the shared folder, with its distinct words, their codes and
the documents' ids. All further passes read chunks by their path and exchange small packed rows.

1. Each window is keyed by the least hash of its runs of 7 words, so that equal windows have equal keys and only
   every fourth window a key of its own. Keys that stand in one document only rule their windows out.
2. The distinct windows that are left meet by 96 bits of hash. The window's first document is the reference; every
   chunk learns which of its windows have an earlier document, in which chunk that lies, and for which its own
   documents are the reference.
3. The reference passages of a chunk are its *shard*: a suffix automaton over words is built of them, where each
   state knows the least id among its documents, and written to the shared folder as flat arrays. A shard
   has no more words than its chunk, so what a task loads is bounded.
4. Passages that may go are streamed through the automaton of the shard that they point to. Matching statistics,
   cut at ``least`` words, tell for each word the state of the window that ends there; the window counts if the
   least id of the state is smaller. Only words decide here, no hashes.
5. Each chunk drops the words of the spans that it gets back.

A passage that many documents share is sent once by each chunk, and the rows for one shard are dealt over many
tasks that load the same automaton; no step gathers the documents of a passage.

Null texts have no words. Documents with a null id are neither earlier nor later than others and stay whole.
Rows that share an id are not earlier than each other. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import coded, give_back, hashes, list_parts, mixed, sliced, spread, texts_of, words_of
from millrace.llm.chunks import loaded, range_cuts, rows_of, saved, steps
from millrace.llm.ngram_model import packed, unpacked
from millrace.scratch import new_path, written

LEAST, RUN = 13, 7
CHUNK_BYTES = 8 << 20
#: Distinct keys or windows that meet in one task.
KEYS = 1 << 20
#: Words that go through one copy of an automaton; a shard that many documents point to has several copies.
COPY_WORDS = 1 << 20
BASE, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def write_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, path, words, documents): a row for each file of texts."""
    folder = new_path(docs.sparkSession, "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, limit=CHUNK_BYTES):
            words, offsets = words_of(texts_of(batch), lambda texts: texts)
            codes, distinct = coded(words)
            path = saved(folder, f"chunk-{number}", {"words": distinct, "codes": pa.array(codes.astype(np.int32)), "offsets": pa.array(offsets), "ids": batch.column(0)})
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (number, path, len(codes), batch.num_rows)], ["chunk", "path", "words", "documents"])
            number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "chunk long, path string, words long, documents long"), "chunks")


class Chunk:
    """The texts of one chunk and their windows; documents without an id have none."""

    def __init__(self, path: str, least: int):
        found = loaded(path)
        self.least, self.names = least, found["words"]
        self.codes = found["codes"].to_numpy().astype(np.int64)
        self.offsets, self.raw_ids = found["offsets"].to_numpy(), found["ids"]
        self.ids = pc.fill_null(self.raw_ids, 0).to_numpy()
        counts = np.maximum(np.diff(self.offsets) - least + 1, 0)
        counts[self.raw_ids.is_null().to_numpy(zero_copy_only=False)] = 0
        self.at = spread(counts, self.offsets[:-1])
        self.document = np.repeat(np.arange(len(counts)), counts)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return hashes(self.names)

    def sums(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """(running sums of the words' hashes times rising powers, the inverse powers); ``turn`` gives other hashes."""
        word = mixed(self.word_hashes + np.uint64(turn))[self.codes]
        power = np.full(len(word) + 1, BASE)
        power[:1] = 1
        back = np.full(len(word) + 1, BACK)
        back[:1] = 1
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * np.cumprod(power)[:-1])]), np.cumprod(back)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys, whether several ids have one, the key's place for each window)."""
        total, back = self.sums(0)
        run = min(RUN, self.least)
        n = len(self.codes) - run + 1
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        least = mixed((total[run:] - total[:-run]) * back[:n])
        width, wanted = 1, self.least - run + 1
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wanted:
            least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
        key = least[self.at] >> np.uint64(16)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (self.document[1:] != self.document[:-1])
        places = np.flatnonzero(fresh)
        distinct, inverse = np.unique(key[places], return_inverse=True)
        low, high = self.bounds(inverse, self.ids[self.document[places]], len(distinct))
        return distinct, low < high, inverse[np.cumsum(fresh) - 1]

    @staticmethod
    def bounds(groups: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min)
        np.minimum.at(low, groups, ids)
        np.maximum.at(high, groups, ids)
        return low, high

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(64 bits, 32 bits) of the distinct windows among the chosen ones, sorted, and the place of each of those."""
        at = self.at[chosen]
        first, back = self.sums(0)
        second, _ = self.sums(1)
        h = mixed((first[at + self.least] - first[at]) * back[at])
        g = mixed((second[at + self.least] - second[at]) * back[at]) >> np.uint64(32)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return h[new], g[new], place

    def texts(self, spans: list[tuple[int, int, int, int]]) -> list[str]:
        """The words of each span, joined by one space."""
        begin, end = np.array([s[2] for s in spans], np.int64), np.array([s[3] for s in spans], np.int64)
        words = self.names.take(pa.array(self.codes[spread(end - begin, begin)]))
        cuts = np.concatenate([[0], np.cumsum(end - begin)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), " ").to_pylist()

    def runs(self, window: np.ndarray, label: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(label, document, begin, end): words under unbroken runs of windows of one document and label."""
        if not len(window):
            return []
        cut = np.flatnonzero((np.diff(window) != 1) | (np.diff(label) != 0) | (np.diff(self.document[window]) != 0))
        begin, end = np.append(0, cut + 1), np.append(cut, len(window) - 1)
        picked = window[begin]
        return list(zip(label[begin].tolist(), self.document[picked].tolist(), self.at[picked].tolist(), (self.at[window[end]] + self.least).tolist()))


ASKED = {"bucket": pa.int32(), "chunk": pa.int64(), "path": pa.string(), "base": pa.int64(), "data": pa.binary()}
ASKED_ROW = "bucket int, chunk long, path string, base long, data binary"


def keys_asked(manifest: DataFrame, buckets: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, many, _ = Chunk(row["path"], least).keys()
                cuts = range_cuts(key, 1 << 48, buckets)
                yield rows_of(ASKED, [(b, row["chunk"], row["path"], 0, packed(steps(key[i:j]), many[i:j].astype(np.int64))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i])
                give_back()

    return manifest.mapInArrow(run, ASKED_ROW)


def keys_answered(asked: DataFrame) -> DataFrame:
    """For each row of keys: a bit each, whether a second document has it."""

    def run(group: pa.Table) -> pa.Table:
        each = [unpacked(data) for data in group["data"].to_pylist()]
        key = np.concatenate([np.cumsum(rises) for rises, _ in each])
        many = np.concatenate([flag for _, flag in each]).astype(bool)
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[inverse[many]] = True
        found = shared[inverse]
        cuts = np.cumsum([0, *[len(rises) for rises, _ in each]])
        data = [packed(np.packbits(found[a:b]), np.array([b - a])) for a, b in zip(cuts, cuts[1:])]
        return group.set_column(group.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    return asked.groupBy("bucket").applyInArrow(run, ASKED_ROW)


def _candidates(chunk: Chunk, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, their distinct hashes in two parts, the place of each): those whose key a second document has."""
    _, _, place = chunk.keys()
    flags = [np.zeros(0, bool)]
    for row in sorted(rows, key=lambda r: r["bucket"]):
        bits, count = unpacked(row["data"])
        flags.append(np.unpackbits(bits.astype(np.uint8), count=int(count[0])).astype(bool))
    chosen = np.flatnonzero(np.concatenate(flags)[place]) if len(place) else np.zeros(0, np.int64)
    return chosen, *chunk.windows(chosen)


def windows_asked(answers: DataFrame, buckets: int, least: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        chunk = Chunk(rows[0]["path"], least)
        chosen, h, g, place = _candidates(chunk, rows)
        low, high = Chunk.bounds(place, chunk.ids[chunk.document[chosen]], len(h))
        cuts, out = range_cuts(h, 1 << 64, buckets), []
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                base = int(low[i:j].min())
                out.append((b, rows[0]["chunk"], rows[0]["path"], base, packed(steps(h[i:j]), g[i:j], low[i:j] - base, high[i:j] - low[i:j])))
        give_back()
        return pa.Table.from_batches([rows_of(ASKED, out)])

    return answers.groupBy("chunk").applyInArrow(run, ASKED_ROW)


ANSWER = {"bucket": pa.int32(), "chunk": pa.int64(), "path": pa.string(), "base": pa.int64(), "data": pa.binary(), "shards": pa.list_(pa.int64())}
ANSWER_ROW = f"{ASKED_ROW}, shards array<long>"


def windows_answered(asked: DataFrame) -> DataFrame:
    """For each row of windows: the shard of an earlier document (0: none, else a place in ``shards`` and 1), the first id, whether it is the reference."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        each = [unpacked(r["data"]) for r in rows]
        cuts = np.cumsum([0, *[len(e[0]) for e in each]])
        h = np.concatenate([np.cumsum(e[0].astype(np.uint64)) for e in each])
        g = np.concatenate([e[1] for e in each])
        low = np.concatenate([e[2] + r["base"] for e, r in zip(each, rows)])
        high = np.concatenate([e[3] for e in each]) + low
        owner = np.repeat(np.array([r["chunk"] for r in rows]), np.diff(cuts))
        order = np.lexsort((owner, low, g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        begin = np.flatnonzero(new)
        group_of = np.cumsum(new) - 1
        first, last = low[order][begin], np.maximum.reduceat(high[order], begin)
        home = np.empty(len(h), np.int64)
        home[order] = owner[order][begin][group_of]
        first_id = np.empty(len(h), np.int64)
        first_id[order] = first[group_of]
        is_reference = np.zeros(len(h), bool)
        is_reference[order[begin]] = last > first
        later = high > first_id
        out = []
        for r, a, b in zip(rows, cuts, cuts[1:]):
            shards, place = np.unique(home[a:b][later[a:b]], return_inverse=True)
            where, begin_id = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
            base = int(first_id[a:b].min())
            where[later[a:b]] = place + 1
            begin_id[later[a:b]] = (first_id[a:b] - base)[later[a:b]]
            out.append((r["bucket"], r["chunk"], r["path"], base, packed(where, begin_id, is_reference[a:b].astype(np.int64)), shards.tolist()))
        return pa.Table.from_batches([rows_of(ANSWER, out)])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER_ROW)


PASSAGES = {
    "shard": pa.int64(), "reference": pa.bool_(), "chunk": pa.int64(), "texts": pa.list_(pa.string()), "ids": pa.list_(pa.int64()),
    "begins": pa.list_(pa.list_(pa.int32())), "words": pa.int64(),
}
PASSAGES_ROW = "shard long, reference boolean, chunk long, texts array<string>, ids array<long>, begins array<array<int>>, words long"


def passages(keys: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    """Reference passages of each chunk, and its passages that may go, each text once for each shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_batches([rows_of(PASSAGES, [])])
        rows, answers = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["bucket"])
        chunk, own = Chunk(rows[0]["path"], least), rows[0]["chunk"]
        chosen, _, _, place = _candidates(chunk, rows)
        shard, first, reference = [], [], []
        for r in answers:
            where, begin, flag = unpacked(r["data"])
            shard.append(np.array([-1, *r["shards"]])[where])
            first.append(begin.astype(np.int64) + r["base"])
            reference.append(flag.astype(bool))
        shard, first, reference = (np.concatenate(v)[place] for v in (shard, first, reference))
        ids = chunk.ids[chunk.document[chosen]]
        low, _ = Chunk.bounds(place, ids, int(place.max(initial=-1)) + 1)
        kept = reference & (ids == low[place])
        spans = chunk.runs(chosen[kept], np.zeros(int(kept.sum()), np.int64))
        out = [(own, True, own, chunk.texts(spans), [int(chunk.ids[d]) for _, d, _, _ in spans], None, 0)] if spans else []
        later = (shard >= 0) & (first < ids)
        met: dict[int, dict[str, list]] = {}
        spans = chunk.runs(chosen[later], shard[later])
        for (label, document, begin, _), text in zip(spans, chunk.texts(spans)):
            found = met.setdefault(label, {}).setdefault(text, [int(chunk.ids[document]), []])
            found[0] = min(found[0], int(chunk.ids[document]))
            found[1].append(begin)
        for label, texts in met.items():
            out.append((label, False, own, list(texts), *map(list, zip(*texts.values())), sum(t.count(" ") + 1 for t in texts)))
        give_back()
        return pa.Table.from_batches([rows_of(PASSAGES, out)])

    return keys.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(run, PASSAGES_ROW)


class Automaton:
    """The suffix automaton of word passages; each state has the least id of the passages that it stands in."""

    def __init__(self, words: dict[str, int], length: np.ndarray, link: np.ndarray, least_id: np.ndarray, source: np.ndarray, word: np.ndarray, target: np.ndarray):
        self.words, self.length, self.link, self.least_id = words, length, link, least_id
        self.source, self.word, self.target = source, word, target

    @staticmethod
    def of(texts: list[str], ids: list[int]) -> Automaton:
        words: dict[str, int] = {}
        length, link, follow, least_id = [0], [-1], [{}], [None]
        last = 0
        for number, (text, own) in enumerate(zip(texts, ids)):
            # a symbol of its own parts each passage from the next
            for symbol in [*[words.setdefault(w, len(words)) for w in text.split(" ")], -1 - number]:
                now = len(length)
                length.append(length[last] + 1)
                link.append(0)
                follow.append({})
                least_id.append(own)
                at = last
                while at >= 0 and symbol not in follow[at]:
                    follow[at][symbol] = now
                    at = link[at]
                if at >= 0:
                    to = follow[at][symbol]
                    if length[to] == length[at] + 1:
                        link[now] = to
                    else:
                        copy = len(length)
                        length.append(length[at] + 1)
                        link.append(link[to])
                        follow.append(dict(follow[to]))
                        least_id.append(least_id[to])
                        while at >= 0 and follow[at].get(symbol) == to:
                            follow[at][symbol] = copy
                            at = link[at]
                        link[to] = link[now] = copy
                last = now
        for state in np.argsort(-np.array(length), kind="stable").tolist():
            up = link[state]
            if up > 0 and least_id[state] < least_id[up]:
                least_id[up] = least_id[state]
        least_id[0] = 0
        source = np.repeat(np.arange(len(length)), [len(f) for f in follow])
        word = np.fromiter((w for f in follow for w in f), np.int64, len(source))
        target = np.fromiter((t for f in follow for t in f.values()), np.int64, len(source))
        kept = word >= 0
        return Automaton(words, np.array(length), np.array(link), np.array(least_id), source[kept], word[kept], target[kept])

    def columns(self) -> dict[str, pa.Array]:
        arrays = {c: pa.array(getattr(self, c)) for c in ("length", "link", "least_id", "source", "word", "target")}
        return arrays | {"words": pa.array(list(self.words), pa.string())}

    @staticmethod
    def load(path: str) -> Automaton:
        found = loaded(path)
        words = {w: k for k, w in enumerate(found.pop("words").to_pylist())}
        return Automaton(words, **{c: v.to_numpy() for c, v in found.items()})

    @cached_property
    def table(self) -> tuple[dict[int, int], list[int], list[int], list[int]]:
        """(target of state and word, lengths, links, least ids) for walks."""
        keys = self.source * max(len(self.words), 1) + self.word
        return dict(zip(keys.tolist(), self.target.tolist())), self.length.tolist(), self.link.tolist(), self.least_id.tolist()

    def matches(self, texts: list[str], ids: list[int], least: int) -> list[list[tuple[int, int]]]:
        """Spans of words of each text under windows of ``least`` words that a passage with a smaller id holds."""
        step, length, link, least_id = self.table
        size, known, out = max(len(self.words), 1), self.words, []
        for text, own in zip(texts, ids):
            state = matched = 0
            spans: list[tuple[int, int]] = []
            for at, word in enumerate(text.split(" ")):
                symbol = known.get(word)
                if symbol is None:
                    state = matched = 0
                    continue
                to = step.get(state * size + symbol)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step.get(state * size + symbol)
                if to is None:
                    continue
                state, matched = to, matched + 1
                # matching statistics count up to ``least`` words: the state is that of the last ``least``
                while length[link[state]] >= least:
                    state = link[state]
                if matched >= least:
                    matched = least
                    if least_id[state] < own:
                        begin = at - least + 1
                        if spans and spans[-1][1] >= begin:
                            spans[-1] = (spans[-1][0], at + 1)
                        else:
                            spans.append((begin, at + 1))
            out.append(spans)
        return out


def write_automata(references: DataFrame) -> DataFrame:
    """(shard, automaton): the automaton of each shard, in a file of the shared folder."""
    folder = new_path(references.sparkSession, "automata")

    def run(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        path = saved(folder, f"shard-{row['shard']}", Automaton.of(row["texts"], row["ids"]).columns())
        return pa.table([pa.array([row["shard"]]), pa.array([path])], ["shard", "automaton"])

    return written(references.groupBy("shard").applyInArrow(run, "shard long, automaton string"), "automata")


def matched(asked: DataFrame, least: int) -> DataFrame:
    """(chunk, begin, end): spans of words that go, from rows sorted by shard."""
    kinds = {"chunk": pa.int64(), "begin": pa.list_(pa.int32()), "end": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = automaton = None
        for batch in batches:
            for row in batch.to_pylist():
                if path != row["automaton"]:
                    path, automaton = row["automaton"], Automaton.load(row["automaton"])
                begin, end = [], []
                for starts, spans in zip(row["begins"], automaton.matches(row["texts"], row["ids"], least)):
                    for a, b in spans:
                        begin += [s + a for s in starts]
                        end += [s + b for s in starts]
                yield rows_of(kinds, [(row["chunk"], begin, end)])
                give_back()

    return asked.mapInArrow(run, "chunk long, begin array<int>, end array<int>")


KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, text string"


def kept_texts(manifest: DataFrame, spans: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left["path"][0].as_py(), 1)
        change = np.zeros(len(chunk.codes) + 1, np.int64)
        begin, end = (list_parts(pa.concat_arrays(right[c].chunks))[0].to_numpy() if right.num_rows else np.zeros(0, np.int64) for c in ("begin", "end"))
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change)[:-1] > 0
        count = np.diff(chunk.offsets)
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(before[chunk.offsets])
        left_words = np.concatenate([[0], np.cumsum(count - removed)])
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left_words, pa.int32()), chunk.names.take(pa.array(chunk.codes[~gone]))), " ")
        # runs of removed words, cut at the ends of documents
        owner = np.repeat(np.arange(len(count)), count)
        edge = np.ones(len(gone), bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(gone))
        runs = gone[starts]
        starts, ends = starts[runs], ends[runs]
        home = owner[starts]
        parts = pa.StructArray.from_arrays([pa.array((v - chunk.offsets[home]).astype(np.int32)) for v in (starts, ends)], ["begin", "end"])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(home, minlength=len(count)))])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)
        give_back()
        return pa.table([chunk.raw_ids, pa.array(count), pa.array(removed), lists, texts], ["doc_id", "n_words", "n_removed", "spans", "text"])

    return manifest.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(run, KEPT)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Each document without the words under windows that a document with a smaller id holds.

    (doc_id, n_words, n_removed, spans, text): ``spans`` are the runs of words that went, ``text`` the others,
    joined by one space.
    """
    manifest = write_chunks(docs)
    chunks, words = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    parts, buckets = max(chunks, 1), words // (4 * KEYS) + 1
    dealt = lambda df, by, n=parts: df.repartition(n, by)  # noqa: E731  by number, so that small rows are not put into few tasks
    asked = keys_asked(manifest.select("chunk", "path").repartition(parts), buckets, least)
    keys = written(keys_answered(dealt(asked, "bucket", buckets)), "key-answers")
    meet = windows_asked(dealt(keys, "chunk"), buckets, least)
    windows = windows_answered(dealt(meet, "bucket", buckets))
    found = written(passages(dealt(keys, "chunk"), dealt(windows, "chunk"), least), "passages")
    automata = write_automata(dealt(found.where("reference").select("shard", "texts", "ids"), "shard"))
    copies = found.groupBy("shard").agg(F.ceil(F.sum("words") / COPY_WORDS).alias("copies")).join(automata, "shard")
    later = found.where("NOT reference").join(copies, "shard")
    copy = F.pmod(F.xxhash64("chunk"), "copies")
    streamed = later.repartition(parts, F.col("shard"), copy).sortWithinPartitions("shard")
    spans = matched(streamed.select("automaton", "chunk", "texts", "ids", "begins"), least)
    return kept_texts(dealt(manifest.select("chunk", "path"), "chunk"), dealt(spans, "chunk"))


def repeats_digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The kept text of each document as its SHA-256."""
    return without_repeats(docs, least).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
