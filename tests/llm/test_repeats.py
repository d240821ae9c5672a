"""Removal of repeated passages against its definition."""

import hashlib
import re

import numpy as np
import pytest

from millrace.llm import repeats

from .conftest import DOCUMENT, document


def expected(rows, least=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for (i, *_), w in zip(rows, words):
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, *_), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - least + 1):
            if i is not None and first[tuple(w[k : k + least])] < i:
                gone[k : k + least] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(prose, odd_rows):
    random = np.random.default_rng(3)
    shared = [prose(n) for n in (12, 13, 14, 40, 60)]
    rows = [document(1000 + i, prose(random.integers(1, 60))) for i in range(60)]
    for i in range(120):
        parts = [prose(random.integers(0, 30)), *random.choice(shared, random.integers(1, 4)).tolist(), prose(random.integers(0, 30))]
        rows.append(document(int(random.integers(0, 5000)), "\n ".join(parts)))
    rows += [document(9000 + i, rows[i][1]) for i in range(30)] + [document(500, rows[3][1])] * 3
    rows += [document(20_000 + i, "la " * (30 + i)) for i in range(5)] + [document(-4, shared[3]), document(None, shared[4])]
    return rows + odd_rows


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_like_definition(spark, stored, corpus, monkeypatch, size):
    """In one chunk a task, and in many."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
    monkeypatch.setattr(repeats, "KEYS", 500)
    assert got(repeats.repeats_digest(stored(corpus, DOCUMENT))) == expected(corpus)


def test_other_thresholds(stored, corpus):
    rows = corpus[:150]
    for least in (3, 20):
        assert got(repeats.repeats_digest(stored(rows, DOCUMENT), least)) == expected(rows, least)


def test_spans_and_texts(stored, prose):
    a, b = prose(30), prose(20)
    rows = [document(1, f"{a} x {b}"), document(2, f"y {b} z {a} w"), document(3, "q")]
    found = {r["doc_id"]: r for r in repeats.without_repeats(stored(rows, DOCUMENT)).collect()}
    assert found[1]["spans"] == [] and found[1]["text"] == rows[0][1]
    assert [tuple(s) for s in found[2]["spans"]] == [(1, 21), (22, 52)] and found[2]["text"] == "y z w"


def test_nothing(stored):
    docs = stored([document(1, "a")], DOCUMENT)
    assert repeats.repeats_digest(docs.limit(0)).count() == 0


def test_automaton_like_all_windows():
    random = np.random.default_rng(8)
    for _ in range(60):
        texts = [" ".join(random.choice(list("abc"), random.integers(3, 40))) for _ in range(6)]
        ids = random.integers(0, 9, 6).tolist()
        automaton = repeats.Automaton.of(texts, ids)
        asked = " ".join(random.choice(list("abcd"), 50))
        own, least, w = int(random.integers(0, 9)), int(random.integers(2, 6)), asked.split()
        plain = np.zeros(len(w), bool)
        for k in range(len(w) - least + 1):
            run = f" {' '.join(w[k : k + least])} "
            if any(run in f" {t} " and i < own for t, i in zip(texts, ids)):
                plain[k : k + least] = True
        (spans,) = automaton.matches([asked], [own], least)
        mine = np.zeros(len(w), bool)
        for a, b in spans:
            mine[a:b] = True
        assert (mine == plain).all()
