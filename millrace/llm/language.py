"""Language identification of words in code-switched text by a linear-chain conditional random field.

Words that hold a letter form the chain of a text. A word's features are hashed: its letters, its 2- and
3-grams with the word's ends marked, its prefix and suffix (4-grams at an end), the word itself, and the
languages whose lexicon (the most frequent words of a language in the sample) holds it. Feature weights and
transitions are learned together by gradient descent on the likelihood of labelled chains; the sums over
all labellings come from forward-backward. Each training chain joins spans of two documents, so that
transitions learn how text stays in a language and how it leaves it. The sample is bounded by ``max_rows`` spans of
at most ``SPAN`` words, shared among the languages; it is fitted on the driver.

A text is labelled whole, in tasks: chains are cut into chunks, the transfer matrix of each chunk is found for
all chunks together, and chunks are then stitched, which is exact and takes as many vectorised steps as a
chunk has words, however long a text is. The language of a text is the one with the largest mean marginal.

Null texts and texts without a letter are ``und`` with score 0. Null languages teach nothing; without any
labelled row every text is ``und``. A null id is not a training row. Rows are judged on their own, whatever their id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import coded, mixed, sliced, spread, texts_of, words_of
from millrace.llm.samples import DRAWS, bounded

BITS, SPAN, CHUNK, LEXICON = 16, 48, 128, 500
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.05, 1e-4
UNKNOWN = "und"


def letters_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word with a letter, the distinct words without other characters, offsets per text)."""
    words, offsets = words_of(texts)
    codes, distinct = coded(words)
    bare = pc.replace_substring_regex(distinct, r"[^\pL\pM]+", "")
    good = pc.match_substring_regex(distinct, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
    if not len(codes):
        return codes, bare, offsets
    kept = good[codes]
    return codes[kept], bare, np.concatenate([[0], np.cumsum(kept)])[offsets]


def features_of(words: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features of all words, offsets per word, share that each feature counts)."""
    listed = words.to_pylist()
    marked = "".join(f"\x02{w}\x03" for w in listed)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in listed], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    end_of = np.repeat(ends, sizes)
    place = np.arange(len(points))
    owner = np.repeat(np.arange(len(listed)), sizes)
    found, of = [], []
    with np.errstate(over="ignore"):
        run = np.zeros(len(points), np.uint64)
        for n in range(1, 5):
            shifted = np.concatenate([points[n - 1 :], np.zeros(n - 1, np.uint64)])
            run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n))
            inside = place + n <= end_of
            if n == 4:
                inside &= (place == starts[owner]) | (place + n == end_of)
            found.append(run[inside])
            of.append(owner[inside])
        total = mixed(run) if not len(points) else np.add.reduceat(mixed(points + (place - starts[owner]).astype(np.uint64) * np.uint64(1 << 32)), starts)
        found.append(mixed(total + np.uint64(5)))
        of.append(np.arange(len(listed)))
    # a lexicon's mark is a bit set of the languages that list the word; each set is a feature
    marks = np.array([lexicon.get(w, 0) for w in listed], np.uint64)
    found.append(mixed(marks + np.uint64(1 << 40)))
    of.append(np.arange(len(listed)))
    ids = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    owners = np.concatenate(of)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(listed))
    return ids[order], np.concatenate([[0], np.cumsum(counts)]), 1 / np.sqrt(np.maximum(counts, 1))


@dataclass(frozen=True)
class Chain:
    """A fitted field: feature weights (2^BITS, languages), transitions, lexicon marks."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def scores(self, words: pa.Array) -> np.ndarray:
        """Score of each language for each distinct word."""
        if not len(words):
            return np.zeros((0, len(self.languages)))
        out = np.empty((len(words), len(self.languages)))
        for at in range(0, len(words), 1 << 16):
            ids, offsets, share = features_of(words.slice(at, 1 << 16), self.lexicon)
            sums = np.add.reduceat(self.weights[ids], offsets[:-1], axis=0)
            out[at : at + (1 << 16)] = sums * share[:, None]
        return out

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each language for each word with a letter, offsets per text)."""
        codes, words, offsets = letters_of(texts)
        if not self.languages:
            return np.zeros((len(codes), 0)), offsets
        used, at = np.unique(codes, return_inverse=True)
        e = self.scores(words.take(pa.array(used)))[at] if len(codes) else np.zeros((0, len(self.languages)))
        alpha, beta = forward_backward(e, self.transitions, offsets)
        both = alpha * beta
        return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300), offsets


def forward_backward(scores: np.ndarray, transitions: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward weights of every word; chunks go side by side."""
    total, width = scores.shape
    alpha, beta = np.ones((total, width)), np.ones((total, width))
    if not total:
        return alpha, beta
    e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -50))
    a = np.exp(transitions - transitions.max())
    lengths = np.diff(offsets)
    many = -(-lengths // CHUNK)
    text = np.repeat(np.arange(len(lengths)), many)
    number = spread(many, np.zeros(len(many), np.int64))
    start = offsets[:-1][text] + number * CHUNK
    size = np.minimum(lengths[text] - number * CHUNK, CHUNK)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    start, size, number = start[order], size[order], number[order]
    follows = rank[np.flatnonzero(np.append(text[1:] == text[:-1], False)) + 1]  # a chunk and the one before it
    before = rank[np.flatnonzero(np.append(text[1:] == text[:-1], False))]
    head = number == 0
    active = np.searchsorted(-size, -np.arange(CHUNK + 1), side="left")  # chunks with more than k words
    steps = int(size.max())

    pass_on = np.broadcast_to(np.eye(width), (len(start), width, width)).copy()
    for k in range(steps):
        n = active[k]
        moved = pass_on[:n] @ a
        if k == 0:
            moved[head[:n]] = 1
        moved *= e[start[:n] + k][:, None, :]
        pass_on[:n] = moved / moved.max(axis=(1, 2), keepdims=True)

    into, out_of = np.ones((len(start), width)), np.ones((len(start), width))
    turn = number[follows]
    for j in range(1, int(number.max()) + 1):
        now = turn == j
        v = np.einsum("ci,cij->cj", into[before[now]], pass_on[before[now]])
        into[follows[now]] = v / v.max(axis=1, keepdims=True)
    for j in range(int(number.max()), 0, -1):
        now = turn == j
        v = np.einsum("cij,cj->ci", pass_on[follows[now]], out_of[follows[now]])
        out_of[before[now]] = v / v.max(axis=1, keepdims=True)

    v = into
    for k in range(steps):
        n = active[k]
        moved = v[:n] @ a
        if k == 0:
            moved[head[:n]] = 1
        moved *= e[start[:n] + k]
        moved /= moved.max(axis=1, keepdims=True)
        v[:n] = moved
        alpha[start[:n] + k] = moved
    v = out_of
    for k in range(steps - 1, -1, -1):
        n = active[k]
        beta[start[:n] + k] = v[:n]
        moved = (e[start[:n] + k] * v[:n]) @ a.T
        v[:n] = moved / moved.max(axis=1, keepdims=True)
    return alpha, beta


def fit_chain(spans: list[tuple[str, str]], epochs: int = EPOCHS) -> Chain:
    """Fit on (language, span of words) pairs by Adam on the likelihood of chains of two spans."""
    languages = sorted({lang for lang, _ in spans})
    width = len(languages)
    if not spans:
        return Chain([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    label = {lang: i for i, lang in enumerate(languages)}
    codes, words, offsets = letters_of(pa.array([s for _, s in spans], pa.string()))
    listed = words.to_pylist()
    lexicon: dict[str, int] = {}
    labels = np.repeat([label[lang] for lang, _ in spans], np.diff(offsets))
    for i in range(min(width, 63)):
        counts = np.bincount(codes[labels == i], minlength=len(listed))
        for w in np.argsort(-counts, kind="stable")[:LEXICON]:
            if counts[w] > 1:
                lexicon[listed[w]] = lexicon.get(listed[w], 0) | (1 << i)
    ids, at, share = features_of(words, lexicon)
    random = np.random.default_rng(8)
    weights, transitions = np.zeros((1 << BITS, width)), np.zeros((width, width))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    step = 0
    full = np.flatnonzero(np.diff(offsets) > 0)
    for _ in range(epochs):
        mixed_up = random.permutation(full)
        for begin in range(0, len(mixed_up), 2 * BATCH):
            some = mixed_up[begin : begin + 2 * BATCH]
            size = np.diff(offsets)[some]
            place = spread(size, offsets[:-1][some])
            used, back = np.unique(codes[place], return_inverse=True)
            counts = at[used + 1] - at[used]
            of_word = spread(counts, at[used])
            edges = np.cumsum(counts) - counts
            e = (np.add.reduceat(weights[ids[of_word]], edges, axis=0) * share[used][:, None])[back]
            ends = np.cumsum(size)
            chain = np.concatenate([[0], ends[1::2] if len(some) % 2 == 0 else np.append(ends[1::2], ends[-1])])
            alpha, beta = forward_backward(e, transitions, chain)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            truth = labels[place]
            gap = gamma.copy()
            gap[np.arange(len(truth)), truth] -= 1
            by_word = np.zeros((len(used), width))
            np.add.at(by_word, back, gap)
            change = np.zeros_like(weights)
            np.add.at(change, ids[of_word], np.repeat(by_word * share[used][:, None], counts, axis=0))
            inner = np.ones(len(truth), bool)
            inner[chain[1:] - 1] = False
            left = np.flatnonzero(inner)
            local = np.exp(e[left + 1] - e[left + 1].max(axis=1, keepdims=True)) * beta[left + 1]
            pairs = alpha[left][:, :, None] * np.exp(transitions - transitions.max())[None] * local[:, None, :]
            pairs /= pairs.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((width, width))
            np.add.at(seen, (truth[left], truth[left + 1]), 1)
            step += 1
            scale = 1 / len(truth)
            for value, gradient, m, s in (
                (weights, change * scale + DECAY * weights, moments[0], moments[1]),
                (transitions, (pairs.sum(axis=0) - seen) * scale + DECAY * transitions, moments[2], moments[3]),
            ):
                m *= 0.9
                m += 0.1 * gradient
                s *= 0.999
                s += 0.001 * gradient**2
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Chain(languages, weights.astype(np.float32), transitions, lexicon)


def is_held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: those whose crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, max_rows: int = 8000) -> Chain:
    """Fit on at most ``max_rows`` labelled documents that are not held out, a span of each.

    Rows are drawn by a hash of id and text, and equal rows count once: an id that many rows bear does not widen the bound.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit_chain([])
    part = F.lit(0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, min(DRAWS, int(max_rows / len(counts) / n * DRAWS) + 1)).otherwise(part)
    some = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(DRAWS)) < part)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words, offsets = words_of(texts_of(batch))
            place = _place(batch.column(2), np.diff(offsets))
            size = np.minimum(np.diff(offsets), SPAN)
            edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            taken = words.take(pa.array(spread(size, offsets[:-1] + place)))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), taken), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), joined], ["lang", "at", "span"])

    rows = some.select("lang", "text", F.xxhash64(F.lit(1), "doc_id").alias("at"))
    rows = bounded(rows.mapInArrow(spans, "lang string, at long, span string"), max_rows)
    return fit_chain(sorted((r["lang"], r["span"]) for r in rows.collect()))


def _place(at: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Where the span of each document begins."""
    room = np.maximum(sizes - SPAN, 0) + 1
    return (at.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) % room.astype(np.uint64)).astype(np.int64)


def languages(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            probability, offsets = chain.marginals(texts_of(batch))
            size = np.diff(offsets)
            full = np.flatnonzero(size) if chain.languages else np.zeros(0, np.int64)
            names = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            if len(full):
                mean = np.add.reduceat(probability, offsets[:-1][full], axis=0) / size[full][:, None]
                names[full] = np.array(chain.languages, object)[mean.argmax(axis=1)]
                score[full] = np.clip(mean.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_spans(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, spans) with the runs of one language in a text: first and last word with a letter, language."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            probability, offsets = chain.marginals(texts_of(batch))
            best = probability.argmax(axis=1) if chain.languages else np.zeros(len(probability), np.int64)
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                cuts = np.flatnonzero(np.diff(best[a:b])) + 1
                edges = [0, *cuts.tolist(), int(b - a)] if b > a and chain.languages else []
                out.append([{"first": s, "last": e - 1, "lang": chain.languages[best[a + s]]} for s, e in zip(edges, edges[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], ["doc_id", "spans"])

    schema = f"doc_id {kind}, spans array<struct<first:bigint,last:bigint,lang:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def predicted_languages(docs: DataFrame, max_rows: int = 8000) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score."""
    found = languages(docs, fit(docs, max_rows))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
