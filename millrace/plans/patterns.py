"""Event pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.patterns import automaton, machine, match
from millrace.patterns.match import Pattern
from millrace.plans.registry import query

ORDER = ["ts", "event_id"]


def _events(t):
    return t.events.select("event_id", "user_id", "event_type", "ts", "value")


def _is(kind):
    return F.col("event_type") == kind


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "pattern_next",
    f"""SELECT user_id, a_id, b_id FROM (SELECT user_id, event_type, event_id AS a_id, lead(event_id) OVER w AS b_id,
        lead(event_type) OVER w AS b_type, lead(value) OVER w AS b_value FROM events {_W})
        WHERE event_type = 'view' AND b_type = 'purchase' AND b_value > 20""",
)
def pattern_next(t):
    """A view directly before a purchase over 20."""
    pattern = Pattern.begin("a", _is("view")).next("b", _is("purchase") & (F.col("value") > 20))
    found = match.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"])
    return found.select("user_id", F.col("a.first.event_id").alias("a_id"), F.col("b.first.event_id").alias("b_id"))


@query(
    "pattern_not_next",
    f"""SELECT user_id, a_id, b_id FROM (SELECT user_id, event_type, event_id AS a_id, lead(event_type) OVER w AS n_type,
        first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER
          (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_id FROM events {_W})
        WHERE event_type = 'view' AND b_id IS NOT NULL AND n_type <> 'click'""",
)
def pattern_not_next(t):
    pattern = Pattern.begin("a", _is("view")).not_next(_is("click")).followed_by("b", _is("purchase"))
    found = match.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"])
    return found.select("user_id", F.col("a.first.event_id").alias("a_id"), F.col("b.first.event_id").alias("b_id"))


@query(
    "pattern_followed_by_within",
    """SELECT a.user_id, a.event_id AS a_id, arg_min(b.event_id, (b.ts, b.event_id)) AS b_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.event_type = 'purchase' WHERE a.event_type = 'click'
       GROUP BY a.user_id, a.event_id, a.ts HAVING min(b.ts) < a.ts + INTERVAL 6 HOUR""",
)
def pattern_followed_by_within(t):
    """Relaxed contiguity with a time limit."""
    pattern = Pattern.begin("a", _is("click")).followed_by("b", _is("purchase")).within(6 * 3600)
    found = match.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"], "ts")
    return found.select("user_id", F.col("a.first.event_id").alias("a_id"), F.col("b.first.event_id").alias("b_id"))


@query(
    "pattern_not_between",
    """WITH x AS (SELECT *, (SELECT min((ts, event_id)) FROM events n WHERE n.user_id = a.user_id AND n.event_type = 'error' AND (n.ts, n.event_id) > (a.ts, a.event_id)) AS stop,
         (SELECT min((ts, event_id)) FROM events n WHERE n.user_id = a.user_id AND n.event_type = 'purchase' AND (n.ts, n.event_id) > (a.ts, a.event_id)) AS hit
         FROM events a WHERE event_type = 'signup')
       SELECT user_id, event_id AS a_id, hit[2] AS b_id FROM x WHERE hit IS NOT NULL AND (stop IS NULL OR hit < stop)""",
)
def pattern_not_between(t):
    """No error between signup and purchase (notFollowedBy)."""
    pattern = Pattern.begin("a", _is("signup")).not_followed_by(_is("error")).followed_by("b", _is("purchase"))
    found = match.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"])
    return found.select("user_id", F.col("a.first.event_id").alias("a_id"), F.col("b.first.event_id").alias("b_id"))


@query(
    "pattern_followed_by_any",
    """SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
       AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts < a.ts + INTERVAL 12 HOUR AND a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def pattern_followed_by_any(t):
    pattern = Pattern.begin("a", _is("click")).followed_by_any("b", _is("purchase")).within(12 * 3600)
    found = match.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"], "ts")
    return found.select("user_id", F.col("a.first.event_id").alias("a_id"), F.col("b.first.event_id").alias("b_id"))


@query(
    "pattern_iterative",
    """SELECT a.user_id, a.event_id AS a_event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS b_event_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts < a.ts + INTERVAL 2 DAY AND b.value > 2 * a.value
       WHERE a.event_type = 'click' GROUP BY a.user_id, a.event_id""",
)
def pattern_iterative(t):
    """A click followed by the first event of more than twice its value (iterative condition, C1)."""
    return match.follow_where(
        _events(t), ["user_id"], ORDER, "ts", _is("click"), F.col("b_value") > 2 * F.col("a_value"), ["event_id", "value"], 2 * 86_400
    ).select("user_id", "a_event_id", "b_event_id")


@query(
    "pattern_timed_out",
    """SELECT user_id, event_id FROM events a WHERE event_type = 'signup' AND ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)
       AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase'
                       AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts < a.ts + INTERVAL 1 DAY)""",
)
def pattern_timed_out(t):
    """Signups without a purchase in a day."""
    pattern = Pattern.begin("a", _is("signup")).followed_by("b", _is("purchase")).within(86_400)
    return match.timed_out(_events(t), ["user_id"], ORDER, pattern, ["user_id", "event_id"], "ts")


@query(
    "pattern_times",
    f"""SELECT user_id, first_id, last_id FROM (SELECT user_id, event_id AS first_id, lead(event_id, 2) OVER w AS last_id,
        event_type = 'view' AND lead(event_type) OVER w = 'view' AND lead(event_type, 2) OVER w = 'view' AS hit FROM events {_W}) WHERE hit""",
)
def pattern_times(t):
    """Three views in a row."""
    pattern = Pattern.begin("v", _is("view")).times(3, consecutive=True)
    found = match.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"])
    return found.select("user_id", F.col("v.first.event_id").alias("first_id"), F.col("v_3.first.event_id").alias("last_id"))


# One letter per event, so that the checking engine can look for the pattern as text.
_LETTERS = """l AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' WHEN 'signup' THEN 's' ELSE 'e' END, '' ORDER BY ts, event_id) AS path,
    list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1),
  s AS (SELECT user_id, path, ids, unnest(generate_series(1, length(path))) AS i FROM l)"""


@query(
    "match_recognize_next_row",
    f"""WITH {_LETTERS}, m AS (SELECT *, regexp_extract(substr(path, i), '^v[vc]+p') AS hit FROM s)
        SELECT user_id, ids[i] AS start_id, ids[i + length(hit) - 1] AS end_id, CAST(length(hit) - 2 AS BIGINT) AS steps FROM m WHERE hit <> ''""",
)
def match_recognize_next_row(t):
    """PATTERN (A B+ C) with the default AFTER MATCH SKIP TO NEXT ROW."""
    return match.match_recognize(
        _events(t),
        ["user_id"],
        ORDER,
        [("a", ""), ("b", "+"), ("c", "")],
        {"a": _is("view"), "b": F.col("event_type").isin("view", "click"), "c": _is("purchase")},
        {"start_id": F.col("a.first.event_id"), "end_id": F.col("c.last.event_id"), "steps": F.col("b.n")},
        ["event_id"],
    )


@query(
    "match_recognize_past_last",
    f"""WITH {_LETTERS}, g AS (SELECT user_id, ids, regexp_replace(path, 'v?[sc]*p', '(\\0)', 'g') AS marked FROM l),
        x AS (SELECT user_id, ids, marked, unnest(generate_series(1, length(marked))) AS k FROM g),
        o AS (SELECT user_id, ids, k, marked, length(replace(replace(substr(marked, 1, k), '(', ''), ')', '')) AS before FROM x WHERE substr(marked, k, 1) = '('),
        z AS (SELECT user_id, ids, before, strpos(substr(marked, k), ')') - 2 AS len FROM o)
        SELECT user_id, ids[before + 1] AS start_id, ids[before + len] AS end_id, CAST(len AS BIGINT) AS size FROM z""",
)
def match_recognize_past_last(t):
    """PATTERN (A? B* C) with AFTER MATCH SKIP PAST LAST ROW."""
    start = F.coalesce("a.first.event_id", "b.first.event_id", "c.first.event_id")
    return match.match_recognize(
        _events(t),
        ["user_id"],
        ORDER,
        [("a", "?"), ("b", "*"), ("c", "")],
        {"a": _is("view"), "b": F.col("event_type").isin("signup", "click"), "c": _is("purchase")},
        {"start_id": start, "end_id": F.col("c.last.event_id"), "size": F.col("end_idx") - F.col("start_idx") + 1},
        ["event_id"],
        after_match="past_last",
    )


@query(
    "match_recognize_skip_to_last",
    f"""WITH RECURSIVE {_LETTERS}, m AS MATERIALIZED (SELECT user_id, i, ids[i] AS start_id, i + length(regexp_extract(substr(path, i), '^v[vc]+')) - 1 AS till,
          ids[i + length(regexp_extract(substr(path, i), '^v[vc]+')) - 1] AS end_id FROM s WHERE regexp_extract(substr(path, i), '^v[vc]+') <> ''),
        c(user_id, i) AS (SELECT user_id, min(i) FROM m GROUP BY 1 UNION
          SELECT c.user_id, min(n.i) FROM c JOIN m ON m.user_id = c.user_id AND m.i = c.i JOIN m n ON n.user_id = c.user_id AND n.i >= greatest(m.till, m.i + 1) GROUP BY c.user_id, c.i)
        SELECT user_id, start_id, end_id FROM c JOIN m USING (user_id, i)""",
)
def match_recognize_skip_to_last(t):
    """PATTERN (A B+) with AFTER MATCH SKIP TO LAST B: the last B may start the next match."""
    return match.match_recognize(
        _events(t),
        ["user_id"],
        ORDER,
        [("a", ""), ("b", "+")],
        {"a": _is("view"), "b": F.col("event_type").isin("view", "click")},
        {"start_id": F.col("a.first.event_id"), "end_id": F.col("b.last.event_id")},
        ["event_id"],
        after_match="last:b",
    )


# The legal transitions of the example state machine, on this table's event types.
TRANSITIONS = {
    ("Initial", "signup"): "W",
    ("Initial", "view"): "X",
    ("W", "click"): "Y",
    ("X", "click"): "Y",
    ("X", "purchase"): "Z",
    ("Y", "purchase"): "Z",
    ("Z", "error"): "Terminal",
}


@query(
    "state_machine_alerts",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       t(a, what, b) AS (VALUES ('Initial', 'signup', 'W'), ('Initial', 'view', 'X'), ('W', 'click', 'Y'), ('X', 'click', 'Y'),
                         ('X', 'purchase', 'Z'), ('Y', 'purchase', 'Z'), ('Z', 'error', 'Initial')),
       p(user_id, i, event_id, before, after, alert) AS (
         SELECT user_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 'Initial', 'Initial', false FROM r WHERE i = 1
         UNION ALL SELECT r.user_id, r.i, r.event_id, p.after, coalesce(t.b, p.after), t.b IS NULL
         FROM p JOIN r ON r.user_id = p.user_id AND r.i = p.i + 1 LEFT JOIN t ON t.a = p.after AND t.what = r.event_type)
       SELECT event_id, user_id, before AS state FROM p WHERE alert""",
)
def state_machine_alerts(t):
    """Illegal transitions per user."""
    found = machine.illegal_transitions(_events(t), "user_id", ORDER, "event_type", TRANSITIONS, "Initial")
    return found.select("event_id", "user_id", "state")


@query(
    "pattern_trailing_optional",
    """SELECT user_id, event_id AS start_id, CASE WHEN lead(event_type) OVER w = 'purchase' THEN lead(event_id) OVER w ELSE event_id END AS end_id
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY event_type = 'view'""",
)
def pattern_trailing_optional(t):
    """A view, and the purchase that follows at once if there is one."""
    define = {"a": F.col("event_type") == "view", "b": F.col("event_type") == "purchase"}
    last = F.coalesce("b.last.event_id", "a.last.event_id")
    measures = {"start_id": F.col("a.first.event_id"), "end_id": last}
    return match.match_recognize(t.events, ["user_id"], ["ts", "event_id"], [("a", ""), ("b", "?")], define, measures, ["event_id"])


_DAY = 86_400


@query(
    "pattern_times_range",
    """WITH p AS (SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, b.event_id AS b_id, b.ts AS b_ts,
         row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS n FROM events a JOIN events b
         ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND a.event_type = 'view' AND b.event_type = 'purchase')
       SELECT user_id, a_id, b_id AS last_id, n FROM p WHERE n BETWEEN 2 AND 3 AND b_ts < a_ts + INTERVAL 5 DAY""",
)
def pattern_times_range(t):
    """A view and two to three purchases after it, other events in between."""
    bought = automaton.repeat(automaton.row("b", _is("purchase"), "followed_by"), 2, 3, "followed_by")
    pattern = automaton.seq(automaton.row("a", _is("view")), bought)
    found = automaton.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"], 5 * _DAY)
    ids = automaton.rows_of("b", "event_id")
    first = F.element_at(automaton.rows_of("a", "event_id"), 1)
    return found.select("user_id", first.alias("a_id"), F.element_at(ids, -1).alias("last_id"), F.size(ids).cast("long").alias("n"))


@query(
    "pattern_until",
    """WITH p AS (SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, b.event_id AS b_id, b.ts AS b_ts,
         row_number() OVER w AS n, first_value((b.ts, b.event_id)) OVER w AS opened FROM events a JOIN events b
         ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND a.event_type = 'view' AND b.event_type = 'click'
         WINDOW w AS (PARTITION BY a.event_id ORDER BY b.ts, b.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       SELECT user_id, a_id, b_id AS last_id, n FROM p WHERE b_ts < a_ts + INTERVAL 5 DAY AND NOT EXISTS (SELECT 1 FROM events e
         WHERE e.user_id = p.user_id AND e.event_type = 'error' AND (e.ts, e.event_id) > p.opened AND (e.ts, e.event_id) < (p.b_ts, p.b_id))""",
)
def pattern_until(t):
    """A view and clicks after it, any number until an error."""
    clicks = automaton.repeat(automaton.row("b", _is("click"), "followed_by"), 1, None, "followed_by", until=_is("error"))
    pattern = automaton.seq(automaton.row("a", _is("view")), clicks)
    found = automaton.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"], 5 * _DAY)
    ids = automaton.rows_of("b", "event_id")
    first = F.element_at(automaton.rows_of("a", "event_id"), 1)
    return found.select("user_id", first.alias("a_id"), F.element_at(ids, -1).alias("last_id"), F.size(ids).cast("long").alias("n"))


@query(
    "pattern_combinations",
    """SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM events a
       JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.event_type = 'view'
       JOIN events c ON a.user_id = c.user_id AND (c.ts, c.event_id) > (b.ts, b.event_id) AND c.event_type = 'view'
       WHERE a.event_type = 'signup' AND c.ts < a.ts + INTERVAL 4 DAY""",
)
def pattern_combinations(t):
    """A signup and every two views after it (C3, all combinations)."""
    views = automaton.repeat(automaton.row("b", _is("view"), "followed_by_any"), 2, 2, "followed_by_any")
    pattern = automaton.seq(automaton.row("a", _is("signup")), views)
    found = automaton.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"], 4 * _DAY)
    ids = automaton.rows_of("b", "event_id")
    first = F.element_at(automaton.rows_of("a", "event_id"), 1)
    return found.select("user_id", first.alias("a_id"), F.element_at(ids, 1).alias("b_id"), F.element_at(ids, 2).alias("c_id"))


@query(
    "match_recognize_alternation",
    f"""WITH {_LETTERS}, m AS (SELECT *, regexp_extract(substr(path, i), '^v(s|cp)+[es]') AS hit FROM s),
        f AS (SELECT user_id, ids[i] AS start_id, ids[i + length(hit) - 1] AS end_id, CAST(length(hit) AS BIGINT) AS size FROM m WHERE hit <> '')
        SELECT f.* FROM f JOIN events a ON a.event_id = start_id JOIN events b ON b.event_id = end_id WHERE b.ts < a.ts + INTERVAL 30 DAY""",
)
def match_recognize_alternation(t):
    """PATTERN (A (B | C D)+ E), one match for each start, as many rounds as there can be."""
    turn = automaton.either(automaton.row("b", _is("signup")), automaton.seq(automaton.row("c", _is("click")), automaton.row("d", _is("purchase"))))
    closing = automaton.row("e", F.col("event_type").isin("error", "signup"))
    pattern = automaton.seq(automaton.row("a", _is("view")), automaton.repeat(turn, 1), closing)
    found = automaton.find(_events(t), ["user_id"], ORDER, pattern, ["event_id"], 30 * _DAY, every=False)
    first, last = F.element_at("events", 1)["row"]["event_id"], F.element_at("events", -1)["row"]["event_id"]
    return found.select("user_id", first.alias("start_id"), last.alias("end_id"), F.size("events").cast("long").alias("size"))
