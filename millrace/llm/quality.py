"""A quality classifier: histogram gradient-boosted trees over statistics of the text.

The statistics (:data:`FEATURES`) are shares and sizes that say nothing about who wrote the text or what its
id is. They are computed in one pass over whole texts. Trees are fitted on the driver on a sample of labelled
rows of at most ``max_rows`` rows (a bound, whatever the size of the corpus); every split is chosen from
histograms of at most ``BINS`` bins per statistic. The fitted trees are flattened into three arrays (statistic
and threshold of every inner place, value of every leaf, trees as complete binary trees), which tasks walk
for all rows of a batch at once.

Null texts count as empty ones and are scored like any text. Null labels teach nothing; several labels of
one id teach once each; without any label every score is 0.5. A null id is never a training row. Repeated
rows get equal scores, an empty table no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import coded, list_parts, sliced, texts_of
from millrace.llm.samples import bounded

FEATURES = (
    "bytes words lines upper lower digit space punctuation other_bytes exclamation pipe symbols "
    "word_length long_words distinct_words top_word repeated_pairs top_pair repeated_lines short_lines "
    "line_length longest_line plain_words capital_words end_marks sentence_length"
).split()
BINS, TREES, DEPTH, RATE, SMOOTH, LEAST = 64, 60, 5, 0.2, 1.0, 4.0


def _classes() -> dict[str, np.ndarray]:
    byte = np.arange(256)
    upper, lower = (byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122)
    digit, space = (byte >= 48) & (byte <= 57), np.isin(byte, [9, 10, 11, 12, 13, 32])
    ascii_rest = (byte > 32) & (byte < 127) & ~upper & ~lower & ~digit
    plain = np.isin(byte, [ord(c) for c in ".,;:'\"!?()-"])
    return {
        "upper": upper, "lower": lower, "digit": digit, "space": space, "punctuation": ascii_rest & plain,
        "symbols": ascii_rest & ~plain, "other_bytes": byte > 127, "exclamation": byte == ord("!"),
        "pipe": byte == ord("|"), "end_marks": np.isin(byte, [ord(c) for c in ".!?"]),
    }


CLASSES = _classes()


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between offsets."""
    run = np.zeros(len(values) + 1, np.int32 if len(values) < 1 << 23 else np.int64)
    np.cumsum(values, out=run[1:])
    return (run[offsets[1:]] - run[offsets[:-1]]).astype(np.float64)


def _maxima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[:-1][full])
    return out


def _distinct(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, count of the most frequent one) of each document."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(codes):
        return np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    keys, counts = np.unique(rows * (int(codes.max()) + 1) + codes, return_counts=True)
    of = keys // (int(codes.max()) + 1)
    edges = np.searchsorted(of, np.arange(len(offsets)))
    return np.diff(edges).astype(np.float64), _maxima(counts.astype(np.float64), edges)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` for each text, in vectorised passes over all bytes, words and lines."""
    n = len(texts)
    data = texts.cast(pa.binary())
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64))])
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    size = np.diff(offsets).astype(np.float64)
    share = lambda part, whole: part / np.maximum(whole, 1)
    out = {"bytes": np.log1p(size)}
    held = {name: _sums(member[raw], offsets) for name, member in CLASSES.items()}
    out |= {name: share(v, size) for name, v in held.items() if name != "end_marks"}

    words, at = list_parts(pc.ascii_split_whitespace(texts))
    codes, distinct = coded(words)
    lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.match_substring_regex(distinct, r"^[\pL]+[.,;:!?]?$").to_numpy(zero_copy_only=False).astype(np.int64)
    capital = pc.match_substring_regex(distinct, r"^[\p{Lu}]{2}").to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.diff(at).astype(np.float64)
    kinds, top = _distinct(codes, at)
    inner = np.ones(max(len(codes) - 1, 0), bool)
    inner[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(codes))] - 1] = False
    few = np.maximum(count - 1, 0)
    pair_codes = codes[:-1] * (len(distinct) + 1) + codes[1:]
    pair_at = np.concatenate([[0], np.cumsum(few.astype(np.int64))])
    _, small = np.unique(pair_codes[inner], return_inverse=True)
    pairs, top_pair = _distinct(small, pair_at)
    out |= {
        "words": np.log1p(count), "word_length": share(_sums(lengths[codes], at), count),
        "long_words": share(_sums((lengths > 20).astype(np.int64)[codes], at), count),
        "distinct_words": share(kinds, count), "top_word": share(top, count),
        "repeated_pairs": 1 - share(pairs, few), "top_pair": share(top_pair, few),
        "plain_words": share(_sums(plain[codes], at), count),
        "capital_words": share(_sums(capital[codes], at), count),
        "sentence_length": share(count, held["end_marks"]), "end_marks": share(held["end_marks"], count),
    }

    lines, line_at = list_parts(pc.split_pattern(texts, "\n"))
    line_codes, line_kinds = coded(lines)
    line_length = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.float64)
    line_count = np.diff(line_at).astype(np.float64)
    different, _ = _distinct(line_codes, line_at)
    out |= {
        "lines": np.log1p(line_count), "repeated_lines": 1 - share(different, line_count),
        "short_lines": share(_sums((line_length < 30).astype(np.int64), line_at), line_count),
        "line_length": share(size, line_count), "longest_line": np.log1p(_maxima(line_length, line_at)),
    }
    return np.stack([out[name] for name in FEATURES], axis=1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


@dataclass(frozen=True)
class Trees:
    """Flattened trees: ``feature`` and ``threshold`` are (trees, 2^depth - 1), ``leaf`` is (trees, 2^depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows go down a tree together."""
        total = np.full(len(rows), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(rows), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees by logistic loss; each level is grown at once from one histogram of gradients."""
    inner, leaves = 2**depth - 1, 2**depth
    positive = float(labels.sum())
    base = float(np.log((positive + 0.5) / (len(labels) - positive + 0.5))) if len(labels) else 0.0
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not 0 < positive < len(labels):
        return empty
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1]).astype(np.float32)) for f in range(width)]
    bins = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = bins + np.arange(width) * BINS
    total = np.full(n, base)
    made = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = labels - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            place = ((at - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (nodes, width, BINS)
            g = np.bincount(place, np.repeat(gradient, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SMOOTH) + (gt - g) ** 2 / (ht - h + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(h < LEAST) | (ht - h < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), BINS)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + node], threshold[first + node] = f, edges[f][b]
            at = 2 * at + 1 + (rows[np.arange(n), feature[at]] > threshold[at])
        leaf = rate * np.bincount(at - inner, gradient, leaves) / (np.bincount(at - inner, weight, leaves) + SMOOTH)
        total += leaf[at - inner]
        for column, value in zip(made, (feature, threshold, leaf)):
            column.append(value)
    return Trees(base, *[np.stack(m) for m in made])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = statistics(texts_of(batch))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), listed], ["doc_id", "statistics"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, statistics array<float>")


def is_held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: those whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = 40_000) -> Trees:
    """Trees fitted on at most ``max_rows`` labelled rows that are not held out, chosen by a hash.

    Only documents of the drawn labels are measured. Equal labels of an id and equal rows (id, label, statistics) count
    once, and the bound is on rows: an id that many rows bear does not widen it.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    drawn = bounded(known.select("doc_id", F.col(column).cast("int").alias("label")), max_rows)
    drawn = F.broadcast(drawn)  # at most max_rows rows of two numbers
    measured = with_statistics(docs.select("doc_id", "text").join(drawn.select("doc_id").distinct(), "doc_id", "left_semi"))
    rows = bounded(measured.join(drawn, "doc_id").select("doc_id", "statistics", "label"), max_rows).toPandas()
    if not len(rows):
        return fit_trees(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    rows["key"] = [tuple(s) for s in rows["statistics"]]
    rows = rows.sort_values(["doc_id", "label", "key"])
    return fit_trees(np.stack(rows["statistics"].to_list()).astype(np.float32), rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of every document, measured and scored in one pass."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(statistics(texts_of(batch))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(walk, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, max_rows=max_rows))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000) -> DataFrame:
    """``docs`` without the rows whose score is below 0.5, all columns kept."""
    trees = fit(docs, labels, max_rows=max_rows)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(trees.score(statistics(texts_of(batch))) >= 0.5))

    return docs.mapInArrow(choose, docs.schema)
