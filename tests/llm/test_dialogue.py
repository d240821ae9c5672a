"""Repair of conversations against a plain search."""

import hashlib
import zlib

import numpy as np
import pytest

from millrace.llm import dialogue

SPACE = " \t\n\x0b\x0c\r"
FIELDS = "conv_id long, turn long, role string, text string, extra int"


def harmed(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def cheapest(initials, faults):
    """(cost, audit, roles) of the best edits, by relaxing (cost, audit) until nothing changes."""
    take = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(len(initials), 0): (0, "", ()), (len(initials), 3): (0, "", ())}
    for i in range(len(initials), -1, -1):
        for _ in range(6):
            for s in range(4):
                new, name = ((3, "assistant") if s == 2 else (2, "user"))
                ways = [best[i, s]] if (i, s) in best else []
                if (i, new) in best:
                    c, a, r = best[i, new]
                    ways.append((c + 2, "I" + a, ((name, None), *r)))
                if i < len(initials):
                    if (i + 1, s) in best:
                        c, a, r = best[i + 1, s]
                        ways.append((c + 3, "D" + a, r))
                    if faults[i] not in (1, 2):
                        more = faults[i] == 3
                        if (s, initials[i]) in take and (i + 1, take[s, initials[i]]) in best:
                            c, a, r = best[i + 1, take[s, initials[i]]]
                            ways.append((c + more, "K" + a, ((None, i), *r)))
                        if (i + 1, new) in best:
                            c, a, r = best[i + 1, new]
                            ways.append((c + 2 + more, "R" + a, ((name, i), *r)))
                if ways:
                    best[i, s] = min(ways, key=lambda w: w[:2])
    return best[0, 0]


def expected(rows):
    out = {}
    after = harmed(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2][:16], r[3][:64], hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit, kept = cheapest(initials, faults)
        lines = [f"{own[i][2] if role is None else role}:{'' if i is None else own[i][3]}" for role, i in kept]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.fixture(scope="module")
def talk():
    random = np.random.default_rng(4)
    roles, ends = ["user", "assistant", "system", "tool", "", None, "umpire"], [".", "!", "?", "", ". \n", "…"]

    def rows(conv, n):
        out = []
        for t in range(n):
            role = roles[t % 2] if random.random() < 0.7 else roles[random.integers(len(roles))]
            text = [None, "", " \t"][random.integers(3)] if random.random() < 0.1 else f"text {random.integers(max(n, 3))}{ends[random.integers(6)]}"
            out.append((conv, None if random.random() < 0.03 else int(t + random.integers(3)), role, text, 1))
        return out

    return rows


def test_like_plain_search(spark, stored, talk, monkeypatch):
    rows = [r for c in range(150) for r in talk(c, int(np.random.default_rng(c).integers(1, 14)))]
    rows += talk(None, 9) + [(7000, 1, "user", "x" * 200_000 + ".", 0), (7000, 2, "assistant", None, 0)] + [(8000, 5, "user", "same.", 0)] * 40
    docs = stored(rows, FIELDS)
    assert got(dialogue.damaged_and_repaired(docs)) == expected(rows)


def test_conversation_over_many_segments(spark, stored, talk, monkeypatch):
    rows = talk(1, 700) + [r for c in range(2, 30) for r in talk(c, 5)] + talk(40, 90)
    segments = dialogue.segments
    monkeypatch.setattr(dialogue, "segments", lambda r: cut(segments(r)))
    from pyspark.sql import functions as F

    def cut(table):  # 16 rows a segment
        return table.withColumn("segment", F.shiftright("id", 4))

    docs = stored(rows, FIELDS)
    assert got(dialogue.damaged_and_repaired(docs)) == expected(rows)


def test_nothing(stored):
    docs = stored([(3, 1, "user", "a.", 0)], FIELDS)
    assert dialogue.damaged_and_repaired(docs.limit(0)).count() == 0
    alone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    gone = got(dialogue.damaged_and_repaired(stored([(3, alone, "user", "a.", 0)], FIELDS)))
    assert gone == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_costs_and_ranks():
    """Arcs have the letters of a plain greedy walk over cheapest arcs."""
    random = np.random.default_rng(2)
    initial, fault = random.integers(0, 4, 400), random.choice([0, 0, 0, 1, 2, 3], 400)
    starts = np.concatenate([[0], np.sort(random.choice(np.arange(1, 400), 60, False)), [400]])
    pieces = dialogue.Pieces(initial, fault, starts, dialogue.Costs())
    pieces.solve(np.broadcast_to(dialogue.Pieces.at_end(dialogue.Costs()), (pieces.count, 4)), np.ones(pieces.count, bool))
    piece, node, _ = pieces.paths(np.zeros(pieces.count, np.int64))
    for p in range(pieces.count):
        own = slice(starts[p], starts[p + 1])
        plain = cheapest(["_sua"[i] if i else "x" for i in initial[own]], fault[own].tolist())
        assert "".join(dialogue.LETTERS[pieces.letter[node[piece == p]]]) == plain[1]
    with pytest.raises(ValueError):
        dialogue.Costs(insert=0)
