"""SQL twins of the queries that SQL can tell, for DuckDB."""

from __future__ import annotations

from millrace.llm.chosen_path import LEAST, SHINGLE
from millrace.llm.secrets import KINDS, SCOPE, STRONG


def _either_case(pattern: str) -> str:
    """``(?i:...)`` with both cases of each ASCII letter spelled out; RE2 would fold other letters too."""
    begin = pattern.index("(?i:")
    end = pattern.index(")", begin)
    inner = "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in pattern[begin + 4 : end])
    return f"{pattern[:begin]}(?:{inner}{pattern[end:]}"


def _kind(k: int, name: str, role: str, strong: bool, pattern: str) -> str:
    headed = name in ("assign", "account")
    pattern = (_either_case(pattern) if "(?i:" in pattern else pattern).replace("'", "''")
    shown = r"chr(1) || '\1' || chr(2) || '\2' || chr(1)" if headed else r"chr(1) || '\1' || chr(1)"
    return f"({k}, '{name}', '{role}', {strong}, {headed}, '{pattern}', {shown})"


_OWN = "string_split(x, chr(2))[-1]"
SECRETS = rf"""
WITH k(kind, name, role, strong, headed, pattern, shown) AS (VALUES {", ".join(_kind(k, *row) for k, row in enumerate(KINDS))}),
d AS (SELECT row_number() OVER () AS r, doc_id, replace(replace(coalesce(text, ''), chr(1), chr(3)), chr(2), chr(3)) AS t FROM documents),
s AS (SELECT r, k.*, string_split(regexp_replace(t, pattern, shown, 'g'), chr(1)) AS p FROM d CROSS JOIN k),
e AS (SELECT r, kind, name, role, strong, headed, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM s),
n AS (SELECT *, length(x) - CASE WHEN i % 2 = 0 AND headed THEN 1 ELSE 0 END AS n FROM e),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM n),
f AS (SELECT r, kind, name, role, strong, a, a + n AS b FROM o WHERE i % 2 = 0 AND CASE name
        WHEN 'assign' THEN length({_OWN}) >= 6 WHEN 'access' THEN length(x) >= 20 WHEN 'hex' THEN true
        WHEN 'secret' THEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')
        WHEN 'account' THEN length({_OWN}) >= 3 ELSE length(x) >= 10 END),
m AS (SELECT w.r, w.kind, w.a,
        max((v.a < w.b AND w.a < v.b AND v.strong)::INT) AS inside,
        max((v.role = 'identifier' AND (v.a >= w.b OR w.a >= v.b))::INT) AS identifier,
        max((v.role = 'secret' AND (v.a >= w.b OR w.a >= v.b))::INT) AS secret
      FROM f w JOIN f v ON v.r = w.r AND greatest(v.a - w.b, w.a - v.b, 0) <= {SCOPE} AND (v.kind <> w.kind OR v.a <> w.a)
      WHERE NOT w.strong GROUP BY ALL),
g AS (SELECT f.* FROM f LEFT JOIN m USING (r, kind, a) WHERE f.strong OR (m.inside = 0 AND CASE f.role
        WHEN 'secret' THEN m.identifier = 1 WHEN 'identifier' THEN m.secret = 1 ELSE m.identifier = 1 AND m.secret = 1 END))
SELECT d.doc_id, {", ".join(f"CAST(count(*) FILTER (g.kind = {k}) AS BIGINT) AS n_{name}" for k, name in enumerate(STRONG))},
  sha256(coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (g.strong), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (g.kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN g USING (r) GROUP BY d.r, d.doc_id
"""

NEAR_COPIES = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(
    [array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, greatest(len(w) - {SHINGLE - 2}, 2))])) END AS s FROM w),
c AS (SELECT row_number() OVER () AS c, s, min(doc_id) AS copy_id, count(*) AS copies, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT c, n, unnest(s) AS g FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n
      HAVING count(*) >= {LEAST} * (a.n + b.n - count(*)) - 1e-9),
t(a, b) AS (SELECT c, c FROM c UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b),
m AS (SELECT t.a AS c, min(copy_id) AS class_id FROM t JOIN c ON c.c = t.b GROUP BY t.a),
n AS (SELECT l.a AS c, count(*) AS n_texts, sum(copies) AS others FROM l JOIN c ON c.c = l.b GROUP BY l.a)
SELECT s.doc_id, CASE WHEN c.c IS NULL THEN s.doc_id ELSE class_id END AS class_id,
  CASE WHEN c.c IS NULL THEN s.doc_id ELSE copy_id END AS copy_id, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts,
  CAST(coalesce(others, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m USING (c) LEFT JOIN n USING (c)
"""
