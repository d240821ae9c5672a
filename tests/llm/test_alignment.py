"""Alignment of two tokenizers against its definition."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import alignment
from millrace.llm.tokens import Encoder, Remembered, vocabulary_path

from .conftest import DOCUMENT, document

PATHS = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    return Encoder(PATHS[0]).model, alignment.PieceSide(PATHS[1]).model


def byte_map():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def groups_of(models, text):
    """[(A ids, B ids)] of one text, read from whole encodings."""
    if not text:
        return []
    a = models[0].encode(" " + text, add_special_tokens=False)
    b = models[1].encode(text)
    table, known = byte_map(), a.ids
    parts = [bytes(table[c] for c in w) for w in a.tokens]
    others = []
    for i in b:
        w = models[1].id_to_piece(i)
        others.append(bytes([int(w[3:5], 16)]) if models[1].is_byte(i) else w.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(parts) != whole or b"".join(others) != whole:
        return []
    ends = [set(np.cumsum([len(p) for p in side]).tolist()) for side in (parts, others)]
    cuts, out = sorted(ends[0] & ends[1]), []
    at = [0, 0]
    used = [0, 0]
    for cut in cuts:
        found = []
        for k, (ids, side) in enumerate(((known, parts), (b, others))):
            own = []
            while used[k] < cut:
                own.append(ids[at[k]])
                used[k] += len(side[at[k]])
                at[k] += 1
            found.append(own)
        out.append(tuple(found))
    return out


def expected(models, rows):
    each = [groups_of(models, r[1]) for r in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in each]
    count = Counter(p for found in links for p in set(found))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, *_), g, found in zip(rows, each, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(count[p] == top[p[0]] for p in found)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(found), best, sum(count[p] for p in found), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_like_definition(stored, prose, odd_rows, models, monkeypatch, size):
    """In one chunk a task, and in many."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    monkeypatch.setattr(alignment, "PAIRS", 300)
    monkeypatch.setattr(alignment, "SALT", 4)
    rows = [document(i, prose(int(n)).capitalize() + ".") for i, n in enumerate(np.random.default_rng(0).integers(1, 60, 60))]
    odd = ["a  b", " a", "b ", "tab\there", "line\n\nline", "▁x y", "x ▁", "zero\0byte", "<s> </s> <unk> <|endoftext|>", "é ﬁ Ａ", "\x1c a", " b　c", "don't  we'll"]
    rows += [document(100 + i, t) for i, t in enumerate(odd)] + odd_rows
    rows = [r for r in rows if r[1] is None or len(r[1]) < 250_000] + [document(900, "xy" * 5000)]
    found = sorted((tuple(r) for r in alignment.alignment_digest(stored(rows, DOCUMENT)).collect()), key=str)
    assert found == expected(models, rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t \x1cab'sé1.!<|>漢▁", max_size=30), min_size=1, max_size=5))
def test_pieces_like_whole_texts(models, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    found = alignment.chunk_columns(batch, *PATHS)
    offsets, codes = found["offsets"].to_numpy(), found["codes"].to_numpy()
    for k, text in enumerate(texts):
        own = [found["texts"][int(c)].as_py() for c in codes[offsets[k] : offsets[k + 1]]]
        plain = groups_of(models, text)
        assert ";".join(own) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain)


def test_nothing(stored):
    docs = stored([document(1, "a")], DOCUMENT)
    assert alignment.alignment_digest(docs.limit(0)).count() == 0


def test_remembered_within_bounds(monkeypatch):
    from millrace.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    calls = []

    def encode(pieces, odd):
        calls.append(list(pieces))
        lengths = [len(p) for p in pieces]
        return np.array([ord(c) for p in pieces for c in p], np.int64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    kept = Remembered(encode)
    for batch in (["ab", "c", ""], ["c", "d", "ab", "eee", "f", "gg"], ["gg", "ab", "eee", "f", "d"]):
        ids, offsets = kept(batch, np.zeros(len(batch), bool))
        assert ["".join(map(chr, ids[a:b])) for a, b in zip(offsets, offsets[1:])] == batch
    assert calls == [["ab", "c", ""], ["d", "eee", "f", "gg"], ["gg", "f"]] and len(kept.place) == 5
