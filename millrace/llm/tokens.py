"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

Such a vocabulary is applied to each run of non-space characters with one space before it on its own, so a
text can be cut before any single space between two other characters without changing its ids. The encoder
uses that: distinct pieces of a slice of texts are encoded once, and a worker process keeps those it has met. Texts with other white space at a cut (two
spaces, a space beside a line end, a space at an end) are encoded as they are, in long stretches between
such safe cuts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.arrays import coded, list_parts, spread

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
ODD = rf"^{SPACES}|{SPACES}$|{SPACES}{SPACES}"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
STRETCH = 1 << 16
#: Slices of this size are encoded at once: the larger, the fewer pieces are encoded twice.
TOKENIZED_BYTES = 8 << 20
BLOCK = 2000


#: What a worker process remembers of pieces: so many of them, and so many of their characters.
REMEMBERED, REMEMBERED_CHARACTERS = 700_000, 12 << 20


class Remembered:
    """Ids of pieces, kept from slice to slice by a worker process: the pieces met first, within bounds.

    ``encode(pieces, odd)`` gives (ids, offsets) of pieces; the flags go with them.
    """

    def __init__(self, encode):
        self.encode, self.left = encode, REMEMBERED_CHARACTERS
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def __call__(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces."""
        get = self.place.get
        place = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(place < 0)
        fresh = [pieces[k] for k in new.tolist()]
        ids, offsets = self.encode(fresh, odd[new]) if fresh else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        known = len(self.place)
        first, last = self.ends[place], self.ends[np.minimum(place + 1, known)]
        begin, length = np.where(place < 0, 0, first), np.where(place < 0, 0, last - first)
        pool = np.concatenate([self.ids[: self.ends[known]], ids.astype(np.int32)])
        begin[new], length[new] = self.ends[known] + offsets[:-1], np.diff(offsets)
        self.keep(fresh, ids, offsets)
        return pool[spread(length, begin)], np.concatenate([[0], np.cumsum(length)])

    def keep(self, pieces: list[str], ids: np.ndarray, offsets: np.ndarray) -> None:
        known, taken = len(self.place), 0
        for piece in pieces:
            if known + taken == REMEMBERED or self.left < len(piece):
                break
            self.place[piece] = known + taken
            self.left -= len(piece)
            taken += 1
        at, end = self.ends[known], self.ends[known] + offsets[taken]
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), int(end) - len(self.ids)), np.int32)])
        if known + taken + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), known + taken + 1 - len(self.ends)), np.int64)])
        self.ids[at:end] = ids[: offsets[taken]]
        self.ends[known + 1 : known + taken + 1] = at + offsets[1 : taken + 1]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process for this vocabulary, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; strings of special tokens are ordinary text. Made once in each task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        words = self.model.get_vocab()
        self.size = max(words.values()) + 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for w, i in words.items() if w.startswith("Ġ")]] = True
        self.remembered, self.remembered_heads = Remembered(self.pieces), Remembered(self.alone)

    def plain(self, text: str) -> np.ndarray:
        """Ids of one text, in stretches."""
        if len(text) <= STRETCH:
            return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        parts, begin = [], 0
        while begin < len(text):
            cut = SAFE_CUT.search(text, begin + STRETCH)
            end = cut.start() if cut else len(text)
            parts.append(self.model.encode_batch_fast([text[begin:end]], add_special_tokens=False)[0].ids)
            begin = end
        return np.concatenate([np.array(p, np.int64) for p in parts])

    def spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces that each follow one space."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), BLOCK):
            block = pieces[at : at + BLOCK]
            got = np.array(
                self.model.encode_batch_fast([" " + " ".join(block)], add_special_tokens=False)[0].ids, np.int64
            )
            first = np.flatnonzero(self.begins[got])
            if len(first) != len(block):
                each = [self.plain(" " + p) for p in block]
                got = np.concatenate(each)
                first = np.cumsum([0, *map(len, each)])[:-1]
            ids.append(got)
            counts.append(np.diff(np.append(first, len(got))))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def pieces(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces that each follow one space; ``odd`` ones hold other white space."""
        ids, offsets = self.spaced([p for p, o in zip(pieces, odd.tolist()) if not o])
        if not odd.any():
            return ids, offsets
        each = [self.plain(" " + pieces[k]) for k in np.flatnonzero(odd).tolist()]
        lengths, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        lengths[~odd], starts[~odd] = np.diff(offsets), offsets[:-1]
        lengths[odd] = [len(e) for e in each]
        starts[odd] = len(ids) + np.cumsum(lengths[odd]) - lengths[odd]
        return np.concatenate([ids, *each])[spread(lengths, starts)], np.concatenate([[0], np.cumsum(lengths)])

    def alone(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces with nothing before them."""
        each = [self.plain(p) for p in pieces]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets per text)."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
        values, offsets = list_parts(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " "))
        codes, distinct = coded(values)
        empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
        ids, ends = self.remembered(distinct.to_pylist(), empty)
        length, start = np.diff(ends)[codes], ends[codes]
        # the first piece of a text has no space before it
        head_codes, heads = coded(values.take(pa.array(offsets[:-1])))
        h_ids, h_ends = self.remembered_heads(heads.to_pylist(), np.zeros(len(heads), bool))
        h_length, h_start = np.diff(h_ends)[head_codes], len(ids) + h_ends[head_codes]
        whole = [self.plain(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
        h_length[odd] = [len(w) for w in whole]
        h_start[odd] = len(ids) + len(h_ids) + np.cumsum(h_length[odd]) - h_length[odd]
        length[offsets[:-1]], start[offsets[:-1]] = h_length, h_start
        pool = np.concatenate([ids, h_ids, *[w.astype(np.int32) for w in whole]])
        total = np.concatenate([[0], np.cumsum(length)])
        # as ``spread``, in half the bytes: a slice has fewer ids than an int32 can count
        places = np.repeat((start - total[:-1]).astype(np.int32), length)
        places += np.arange(len(places), dtype=np.int32)
        return pool.take(places), total[offsets] if len(texts) else np.zeros(1, np.int64)
