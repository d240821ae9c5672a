"""The pattern automaton against a search through all words of a pattern, with one key holding most events."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.patterns import automaton as m

SECONDS = 18
ROUNDS = 10  # no more rows stand in a window beside the first


def is_(letter):
    return F.col("e") == letter


def one(letter, link="next"):
    return m.row(letter, is_(letter), link)


NAMES = ["range", "plus", "strict", "until", "combinations", "either", "group", "lazy", "optional first", "nested until"]


def patterns():
    ending = is_("d")
    loose, any_ = "followed_by", "followed_by_any"
    b = one("b", loose)
    return {
        "range": m.seq(one("a"), m.repeat(b, 2, 3, loose)),
        "plus": m.seq(one("a"), m.repeat(b, 1, None, loose), one("c", loose)),
        "strict": m.seq(one("a"), m.repeat(one("b"), 0, 2), one("c")),
        "until": m.seq(one("a"), m.repeat(b, 1, None, loose, until=ending), one("c", loose)),
        "combinations": m.seq(one("a"), m.repeat(one("b", any_), 2, 3, any_), one("c", loose)),
        "either": m.seq(one("a"), m.repeat(m.either(one("b"), m.seq(one("c"), one("d"))), 1, None), m.either(one("c"), one("b"))),
        "group": m.seq(m.repeat(m.seq(one("a"), one("b", loose)), 1, 2, loose), one("c", loose)),
        "lazy": m.seq(one("a"), m.repeat(m.either(one("a"), one("b")), 1, None, greedy=False), m.either(one("b"), one("c"))),
        "optional first": m.seq(m.repeat(one("a"), 0, 1), one("b", loose), m.repeat(one("c", loose), 0, 1)),
        "nested until": m.seq(one("a"), m.repeat(m.seq(b, m.repeat(one("c", loose), 0, 2, loose)), 1, 3, loose, until=ending)),
    }


def words(part, link, end=()):
    """All words of a part, most wanted first: (letter, link, letters that close the way); rounds are bounded."""
    if isinstance(part, m.Row):
        return [[(part.name, link, end)]]
    if isinstance(part, m.Either):
        return [w for p in part.parts for w in words(p, link, end)]
    if isinstance(part, m.Seq):
        out = [[]]
        for i, p in enumerate(part.parts):
            out = [w + v for w in out for v in words(p, p.link if i else link, end)]
        return out
    inner = end if part.until is None else (*end, "d")

    def rounds(n):
        more = []
        if n < (part.most or ROUNDS):
            turn = words(part.part, link if n == 0 else part.inner, end if n == 0 else inner)
            more = [w + v for w in turn for v in rounds(n + 1)]
        stop = [[]] if n >= part.least else []
        return more + stop if part.greedy else stop + more

    return rounds(0)


def placed(word, rows, at):
    """All ways to put a word on rows, its first letter on row ``at``."""
    if rows[at][1] != word[0][0]:
        return []
    out = [[at]]
    for letter, link, end in word[1:]:
        grown = []
        for way in out:
            for i in range(way[-1] + 1, len(rows)):
                if rows[i][1] in end:
                    break
                if rows[i][1] == letter:
                    grown.append([*way, i])
                if link == "next" or (link == "followed_by" and rows[i][1] == letter):
                    break
        out = grown
    return [w for w in out if rows[w[-1]][0] - rows[at][0] < SECONDS]


def searched(pattern, events, every):
    found = []
    listed = words(pattern, "next")
    for key in {e[0] for e in events}:
        rows = [(at, letter, i) for k, at, i, letter in sorted(events, key=lambda e: (e[1], e[2])) if k == key]
        for start in range(len(rows)):
            own = [(key, tuple((w[0], rows[i][2]) for w, i in zip(word, way))) for word in listed if word for way in placed(word, rows, start)]
            found += own if every else own[:1]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def events():
    random.seed(5)
    return [(random.choice(["h", "h", "h", "x", None]), int(i * 1.7) - 100, i, random.choice("aabbccd")) for i in range(160)]


@pytest.fixture(scope="module")
def rows(spark, events):
    made = spark.createDataFrame([*events, ("h", None, 1000, "a")], "k string, at bigint, id bigint, e string")
    return made.withColumn("ts", F.timestamp_seconds("at")).withColumn("events", F.lit("clash")).withColumn("_bits", F.lit(0))


def shown(found):
    return sorted(((r["k"], tuple((e["stage"], e["row"]["id"]) for e in r["events"])) for r in found.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_all_matches(rows, events, name):
    pattern = patterns()[name]
    assert shown(m.find(rows, ["k"], ["ts", "id"], pattern, ["id"], SECONDS)) == searched(pattern, events, True)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("combinations", "nested until")])
def test_one_match_for_each_start(rows, events, name):
    pattern = patterns()[name]
    assert shown(m.find(rows, ["k"], ["ts", "id"], pattern, ["id"], SECONDS, every=False)) == searched(pattern, events, False)


def test_open_matches_are_bounded_where_a_start_gives_one(spark):
    machine = m.Automaton(patterns()["combinations"])
    b = machine.row
    open_, bits = [], {"a": 1 << machine.states[machine.entry[0][0]][0]}
    loose = next(i for i, s in enumerate(machine.states) if s[1] == "b")
    bits["b"] = 1 << machine.states[loose][0]
    most = 0
    for n, letter in enumerate("a" + "b" * 200):
        open_, _ = b(open_, bits[letter], n, 10_000, {"id": n}, n, n == 0, False)
        most = max(most, len(open_))
    assert most <= len(machine.states) + 1


def test_empty_table_and_refusals(rows):
    assert m.find(rows.limit(0), ["k"], ["ts", "id"], one("a"), ["id"], SECONDS).count() == 0
    for wrong in (
        lambda: m.repeat(m.repeat(one("a"), 0, 1), 1), lambda: m.repeat(one("a"), 2, 1), lambda: one("a", "later"), lambda: m.seq(),
        lambda: m.Automaton(m.repeat(one("a"), 0, 1)), lambda: m.find(rows, ["k"], ["ts"], one("a"), ["id"], 0),
    ):
        with pytest.raises(ValueError):
            wrong()
