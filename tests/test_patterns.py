"""Patterns against a plain search over small event lists, with one key holding most events."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.patterns import machine, match
from millrace.patterns.match import Pattern

ORDER = ["at", "id"]


@pytest.fixture(scope="module")
def events():
    random.seed(11)
    return [(random.choice("hhhxy"), i // 2, i, random.choice("abcd")) for i in range(300)]


@pytest.fixture(scope="module")
def rows(spark, events):
    return spark.createDataFrame(events, "k string, at bigint, id bigint, e string").withColumn("ts", F.timestamp_seconds("at"))


def is_(letter):
    return F.col("e") == letter


def paths(events):
    out = {}
    for k, _, i, e in sorted(events, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, ([], []))
        out[k][0].append(e)
        out[k][1].append(i)
    return {k: ("".join(e), ids) for k, (e, ids) in out.items()}


def spans(found, *stages):
    return sorted((r["k"], *[r[s]["first"]["id"] for s in stages]) for r in found.collect())


@pytest.mark.parametrize(
    ("pattern", "regex"),
    [
        ([("a", ""), ("b", "+"), ("c", "")], "a[ab]+c"),
        ([("a", ""), ("b", "*"), ("c", "")], "a[ab]*c"),
        ([("a", ""), ("b", "?"), ("c", "")], "a[ab]?c"),
        ([("a", ""), ("b", "+?"), ("c", "")], "a[ab]+?c"),
        ([("b", "+"), ("d", "")], "[ab]+d"),
        ([("a", ""), ("b", "+")], "a[ab]+"),
        ([("a", ""), ("any", "+?"), ("c", "")], "a.+?c"),
        ([("a", ""), ("b", "?")], "a[ab]?"),
        ([("a", ""), ("b", "*")], "a[ab]*"),
        ([("a", ""), ("b", "*?")], "a[ab]*?"),
        ([("a", ""), ("any", "*?"), ("c", "")], "a.*?c"),
        ([("a", "+"), ("c", "?"), ("d", "*")], "a+c?d*"),
    ],
)
@pytest.mark.parametrize("skip", ["next", "past_last"])
def test_row_patterns(rows, events, pattern, regex, skip):
    define = {"a": is_("a"), "b": F.col("e").isin("a", "b"), "c": is_("c"), "d": is_("d")}
    first, last = pattern[0][0], F.coalesce(*[F.col(f"{name}.last.id") for name, _ in reversed(pattern)])
    out = match.match_recognize(
        rows, ["k"], ORDER, pattern, define, {"s": F.col(f"{first}.first.id"), "e": last}, ["id"], skip
    )
    want = []
    for k, (path, ids) in paths(events).items():
        i = 0
        while i < len(path):
            hit = re.compile(regex).match(path, i)
            if hit:
                want.append((k, ids[i], ids[hit.end() - 1]))
            i = hit.end() if hit and skip == "past_last" else i + 1
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_followed_by_and_negation(rows, events):
    plain = Pattern.begin("a", is_("a")).followed_by("b", is_("b"))
    without = Pattern.begin("a", is_("a")).not_followed_by(is_("c")).followed_by("b", is_("b"))
    not_next = Pattern.begin("a", is_("a")).not_next(is_("b")).next("x", F.lit(True))
    want = {"plain": [], "without": [], "not_next": []}
    for k, (path, ids) in paths(events).items():
        for i, e in enumerate(path):
            if e != "a":
                continue
            j = path.find("b", i + 1)
            if j > 0:
                want["plain"].append((k, ids[i], ids[j]))
                if "c" not in path[i + 1 : j]:
                    want["without"].append((k, ids[i], ids[j]))
            if i + 1 < len(path) and path[i + 1] != "b":
                want["not_next"].append((k, ids[i], ids[i + 1]))
    assert spans(match.find(rows, ["k"], ORDER, plain, ["id"]), "a", "b") == sorted(want["plain"])
    assert spans(match.find(rows, ["k"], ORDER, without, ["id"]), "a", "b") == sorted(want["without"])
    assert spans(match.find(rows, ["k"], ORDER, not_next, ["id"]), "a", "x") == sorted(want["not_next"])


def test_three_stages_within(rows, events):
    pattern = Pattern.begin("a", is_("a")).followed_by("b", is_("b")).next("c", is_("c")).within(9)
    want = []
    at = {i: t for _, t, i, _ in events}
    for k, (path, ids) in paths(events).items():
        for i, e in enumerate(path):
            j = path.find("b", i + 1)
            if e == "a" and j > 0 and path[j + 1 : j + 2] == "c" and at[ids[j + 1]] - at[ids[i]] < 9:
                want.append((k, ids[i], ids[j], ids[j + 1]))
    assert spans(match.find(rows, ["k"], ORDER, pattern, ["id"], "ts"), "a", "b", "c") == sorted(want)


def test_followed_by_any(rows, events):
    pattern = Pattern.begin("a", is_("a")).followed_by_any("b", is_("b")).within(5)
    want = []
    for k, t, i, e in events:
        for k2, t2, i2, e2 in events:
            if k == k2 and (e, e2) == ("a", "b") and (t2, i2) > (t, i) and t2 - t < 5:
                want.append((k, i, i2))
    assert spans(match.find(rows, ["k"], ORDER, pattern, ["id"], "ts"), "a", "b") == sorted(want)


def test_times_and_groups(rows, events):
    twice = Pattern.begin("a", is_("a")).times(2, consecutive=True)
    grouped = Pattern.begin("c", is_("c")).group(twice, "next")
    want = []
    for k, (path, ids) in paths(events).items():
        want += [(k, ids[m.start()]) for m in re.finditer("(?=caa)", path)]
    assert spans(match.find(rows, ["k"], ORDER, grouped, ["id"]), "c") == sorted(want)


def test_builder_rules():
    begun = Pattern.begin("a", None)
    with pytest.raises(ValueError):
        begun.next("a", None)
    with pytest.raises(ValueError):
        begun.next("b", None, "{2}")


def test_state_machine(rows, events):
    table = {("I", "a"): "W", ("I", "c"): "X", ("W", "b"): "Y", ("X", "b"): "Y", ("X", "d"): "Z", ("Y", "d"): "T"}
    out = machine.illegal_transitions(rows.drop("ts"), "k", ORDER, "e", table, "I")
    want, states = [], {}
    for k, _, i, e in sorted(events, key=lambda r: (r[1], r[2])):
        now = states.get(k, "I")
        if (now, e) in table:
            states[k] = "I" if table[now, e] in ("T", "Z") else table[now, e]
        else:
            want.append((i, now))
    assert sorted((r["id"], r["state"]) for r in out.collect()) == sorted(want)


def test_trailing_optional_within(spark):
    """A last optional row that comes too late is left out, not the match."""
    rows = spark.createDataFrame([("k", 0, 0, "a"), ("k", 5, 1, "b"), ("k", 20, 2, "a"), ("k", 40, 3, "b")], "k string, at bigint, id bigint, e string")
    rows = rows.withColumn("ts", F.timestamp_seconds("at"))
    pattern = Pattern.begin("a", is_("a")).next("b", is_("b"), "?").within(10)
    found = match.find(rows, ["k"], ORDER, pattern, ["id"], "ts").select("start_idx", "end_idx").collect()
    assert sorted(map(tuple, found)) == [(0, 1), (2, 2)]


def test_negation_before_followed_by_any(spark):
    rows = spark.createDataFrame([("k", i, i, e) for i, e in enumerate("acbab")], "k string, at bigint, id bigint, e string")
    rows = rows.withColumn("ts", F.timestamp_seconds("at"))
    pattern = Pattern.begin("a", is_("a")).not_next(is_("c")).followed_by_any("b", is_("b")).within(100)
    found = match.find(rows, ["k"], ORDER, pattern, ["id"], "ts").select("start_idx", "end_idx").collect()
    assert sorted(map(tuple, found)) == [(3, 4)]
    with pytest.raises(ValueError):
        match.find(rows, ["k"], ORDER, Pattern.begin("a", is_("a")).not_followed_by(is_("c")).followed_by_any("b", is_("b")).within(100), ["id"], "ts")
