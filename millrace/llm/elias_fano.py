"""Elias-Fano sequences and a trie of n-grams on them, for vectorised look-up in memory-mapped bytes."""

from __future__ import annotations

import struct

import numpy as np

#: Values whose low bits are packed at once; a multiple of 64, so that a slice ends with a whole word.
SLICE = 1 << 16
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (0 or 1) packed into 64-bit words, the first bit lowest."""
    padded = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
    return np.packbits(padded, bitorder="little").view("<u8")


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` of each word."""
    place, left, rest = np.zeros(len(words), np.uint64), rank.astype(np.int64), words.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(rest & ((ONE << np.uint64(half)) - ONE)).astype(np.int64)
        up = left >= low
        left = np.where(up, left - low, left)
        place += np.where(up, np.uint64(half), np.uint64(0))
        rest = np.where(up, rest >> np.uint64(half), rest)
    return place.astype(np.int64)


class Monotone:
    """A non-decreasing sequence of whole numbers: low bits packed, high bits in unary."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones

    @staticmethod
    def of(values: np.ndarray) -> Monotone:
        values = values.astype(np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        bits = max((top + 1) // max(count, 1), 1).bit_length() - 1
        low, places = [], np.arange(bits, dtype=np.uint64)
        for at in range(0, count if bits else 0, SLICE):  # spread bits take 8 bytes each: a slice at a time
            low.append(_words(((values[at : at + SLICE, None] >> places) & ONE).astype(np.uint8).ravel()))
        high = np.zeros(count + (top >> bits) + 1, np.uint8)
        for at in range(0, count, SLICE):
            some = (values[at : at + SLICE] >> np.uint64(bits)).astype(np.int64)
            high[some + np.arange(at, at + len(some))] = 1
        # one spare word, so that two neighbouring words can always be read
        return Monotone(count, bits, np.concatenate([*low, np.zeros(1, np.uint64)]).astype("<u8"), _words(high))

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        # the part that lies in the next word; a shift by 64 is undefined, so it is made in two steps
        second = (self.low[word + 1] << ONE) << (np.uint64(63) - shift)
        return (first | second) & ((ONE << np.uint64(self.low_bits)) - ONE)

    def at(self, at: np.ndarray) -> np.ndarray:
        """Values at these places."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        place = word * 64 + _in_word(self.high[word], at - self.ones[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(at)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below each of ``high``: the ones before zero number ``high - 1``."""
        rank = high - 1
        inside = (rank >= 0) & (rank < self.zeros[-1])
        safe = np.where(inside, rank, 0)
        word = np.minimum(np.searchsorted(self.zeros, safe, side="right") - 1, len(self.high) - 1)
        place = word * 64 + _in_word(self.high[word] ^ ALL, safe - self.zeros[word])
        return np.where(inside, np.minimum(place - safe, self.count), np.where(rank < 0, 0, self.count))

    def successor(self, values: np.ndarray) -> np.ndarray:
        """First place with a value not below each of ``values`` (``count`` if there is none)."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        begin, end = self._below(high), self._below(high + 1)
        wanted = values & ((ONE << np.uint64(self.low_bits)) - ONE)
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return begin
            middle = (begin[open_] + end[open_]) // 2
            less = self.lows(middle) < wanted[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.count, self.low_bits, len(self.low), len(self.high)], "<u8"), self.low, self.high]


class Trie:
    """Two levels: contexts, and under each its successors with quantised probabilities.

    ``contexts`` holds the context keys; ``pointers`` the first successor of each; ``bases`` what is added to
    the successors of a context, so that all of them make one increasing sequence ``successors``. A look-up finds
    the context, adds its base to the word and searches the successor of that sum; the word is relative to its
    context all along. Probabilities and back-off weights are bytes into codebooks of log10 values.
    """

    def __init__(self, parts: list[np.ndarray]):
        it = iter(parts)
        self.levels = [Monotone(int(h[0]), int(h[1]), low, high) for h, low, high in ((next(it), next(it), next(it)) for _ in range(4))]
        self.contexts, self.pointers, self.bases, self.successors = self.levels
        self.codes, self.weights = next(it).view(np.uint8), next(it).view(np.uint8)
        self.codebook, self.weightbook = next(it).view("<f8"), next(it).view("<f8")

    @staticmethod
    def build(contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, logs: np.ndarray, weights: np.ndarray) -> bytes:
        """Bytes of a trie from sorted contexts, their numbers of successors, the successors in order and log10 values."""
        ends = np.cumsum(sizes)
        widest = np.zeros(len(contexts), np.int64)
        if len(words):
            widest = np.maximum.reduceat(words, ends - sizes) + 1
        bases = np.cumsum(widest) - widest
        codes, book = quantised(logs)
        codes_w, book_w = quantised(weights)
        parts: list[np.ndarray] = []
        for values in (contexts, np.append(ends - sizes, len(words)), bases, words + np.repeat(bases, sizes)):
            parts += Monotone.of(values).parts()
        parts += [_padded(codes), _padded(codes_w), book, book_w]
        sized = [p.astype("<u8") if p.dtype == np.uint64 else p for p in parts]
        head = struct.pack("<4sI", b"EFT1", len(sized)) + np.array([len(p) * p.itemsize for p in sized], "<u8").tobytes()
        return head + b"".join(p.tobytes() for p in sized)

    @staticmethod
    def over(data: np.ndarray) -> Trie:
        """A trie on bytes (a memory map, for instance); nothing is copied."""
        name, count = struct.unpack("<4sI", data[:8].tobytes())
        if name != b"EFT1":
            raise ValueError("this is no trie")
        sizes = data[8 : 8 + 8 * count].view("<u8").astype(np.int64)
        ends = 8 + 8 * count + np.cumsum(sizes)
        return Trie([data[e - s : e].view("<u8") for s, e in zip(sizes, ends)])

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the pair is there, its log10 probability, log10 back-off weight or nan without the context).

        A word below 0 is known to be in no pair.
        """
        n = len(contexts)
        log, weight, there = np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
        if not n or not self.contexts.count:
            return there, log, weight
        at = self.contexts.successor(contexts)
        safe = np.minimum(at, self.contexts.count - 1)
        known = np.flatnonzero((at < self.contexts.count) & (self.contexts.at(safe) == contexts.astype(np.uint64)))
        at = at[known]
        weight[known] = self.weightbook[self.weights[at]]
        asked = words[known] >= 0
        known, at = known[asked], at[asked]
        begin, end = self.pointers.at(at).astype(np.int64), self.pointers.at(at + 1).astype(np.int64)
        wanted = self.bases.at(at) + words[known].astype(np.uint64)
        place = self.successors.successor(wanted)
        inside = (place >= begin) & (place < end)
        place = np.where(inside, place, begin)
        hit = inside & (self.successors.at(place) == wanted)
        there[known] = hit
        log[known[hit]] = self.codebook[self.codes[place[hit]]]
        return there, log, weight


def _padded(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes, np.zeros(-len(codes) % 8, np.uint8)])


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(one byte for each value, codebook): bins of equal width, each shown by the mean of its values.

    No value is shown by one further away than a 256th of the range.
    """
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(levels)
    low, width = float(values.min()), float(values.max() - values.min())
    codes = np.zeros(len(values), np.uint8)
    for at in range(0, len(values) if width else 0, SLICE):
        codes[at : at + SLICE] = np.minimum(((values[at : at + SLICE] - low) * (levels / width)).astype(np.int64), levels - 1)
    count = np.bincount(codes, minlength=levels)
    # differences are added up, so that a bin of one value shows exactly that value
    return codes, low + np.bincount(codes, values - low, levels) / np.maximum(count, 1)
