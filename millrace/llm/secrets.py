"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong spans are reported wherever they stand: ``assign`` (a key word, a sign and a value), ``access`` (access
identifiers) and ``hex`` (long lower-case hexadecimal runs). Weak candidates say little alone: ``secret`` (a
long mixed token of any length), ``account`` (an account name behind its key word) and ``endpoint`` (an address). The parts
of a credential are an identifier (access, account), a secret (assign, hex, secret) and an endpoint. An
interval join links parts of different roles that lie within one scope (a number of code points between
them, in one document). A weak secret is reported if an identifier is in its scope, an account if a secret is,
an endpoint if both are; weak candidates that overlap a strong span are that span and are not reported.

Positions come from the text itself: every match is put between two marks, the text is split at the marks,
and running sums of the lengths of the parts give the offsets. Mark characters in a text are replaced by
another character of one code point first, which no pattern matches.

A null text is empty. Each row is a document of its own, whatever its id (null and repeated ids included);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import numbered, written

MARK, INNER, OTHER = "\x01", "\x02", "\x03"
KEY = r"(?i:password|passwd|secret|token|api_?key)"
NAME = r"(?i:username|user|login|account|client_?id)"
SIGN = r"""["']?\x20*[:=]\x20*["']?"""
SCHEME = r"(?i:https?|ftp|s3|postgresql|postgres|mysql|mongodb|redis|amqp)"

#: kind, role, strong, pattern of (head)(value) or of (value), in the order in which kinds of one start are listed
KINDS = (
    ("assign", "secret", True, rf"({KEY}{SIGN})([A-Za-z0-9+/_.=-]+)"),
    ("access", "identifier", True, r"(AKIA[A-Z0-9]+)"),
    ("hex", "secret", True, r"([0-9a-f]{24,})"),
    ("secret", "secret", False, r"([A-Za-z0-9+/_=-]{32,})"),
    ("account", "identifier", False, rf"({NAME}{SIGN})([A-Za-z0-9._@-]+)"),
    ("endpoint", "endpoint", False, rf"""({SCHEME}://[^\x00-\x20"'<>]+)"""),
)
STRONG = [k for k, _, strong, _ in KINDS if strong]
SCOPE = 200


def _headed(pattern: str) -> bool:
    return pattern.startswith(("({", f"({KEY}", f"({NAME}"))


def _segments(kind: int, pattern: str, text: Column) -> tuple[Column, Column]:
    """(parts of the text between and in matches, a list of their lengths and values made from them)."""
    marked = f"{MARK}$1{INNER}$2{MARK}" if _headed(pattern) else f"{MARK}$1{MARK}"
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(marked)), MARK, -1)
    inner = 1 if _headed(pattern) else 0
    name = f"parts_{kind}"
    listed = F.transform(
        F.col(name),
        lambda part, at: F.struct(
            F.lit(kind).alias("kind"),
            at.alias("at"),
            (F.length(part) - F.when(at % 2 == 1, inner).otherwise(0)).alias("size"),
            F.when(at % 2 == 1, part).alias("value"),
        ),
    )
    nothing = F.array().cast("array<struct<kind:int,at:int,size:int,value:string>>")
    return parts.alias(name), F.when(F.size(name) > 1, listed).otherwise(nothing)


def _kept(kind: Column, value: Column) -> Column:
    """Whether a match is long and mixed enough for its kind."""
    own = F.element_at(F.split(value, INNER), -1)
    rules = {
        "assign": F.length(own) >= 6,
        "access": F.length(value) >= 20,
        "hex": F.lit(True),
        "secret": value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]"),
        "account": F.length(own) >= 3,
        "endpoint": F.length(value) >= 10,
    }
    said = F.lit(False)
    for k, (name, *_) in enumerate(KINDS):
        said = F.when(kind == k, rules[name]).otherwise(said)
    return said


def candidates(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, kind, start, end, value) of all strong and weak matches, written once.

    A document without any has one row with null kind. ``row`` numbers the documents (as given, if they
    are to be joined to the spans again).
    """
    text = F.coalesce("text", F.lit(""))
    clean = F.when(
        text.contains(MARK) | text.contains(INNER), F.translate(text, MARK + INNER, OTHER + OTHER)
    ).otherwise(text)
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(number.alias("row"), "doc_id", clean.alias("text"))
    both = [_segments(k, pattern, F.col("text")) for k, (_, _, _, pattern) in enumerate(KINDS)]
    split = rows.select("row", "doc_id", *[parts for parts, _ in both])
    parts = split.select("row", "doc_id", F.explode_outer(F.concat(*[listed for _, listed in both])).alias("part"))
    each = parts.select("row", "doc_id", "part.*")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    good = (F.col("at") % 2 == 1) & _kept(F.col("kind"), F.col("value"))
    # documents keep a row of their own so that none is lost when all their matches fail
    alone = F.col("kind").isNull() | (F.col("at") == 0)
    spans = placed.where(alone | good).select(
        "row",
        "doc_id",
        F.when(good, F.col("kind")).alias("kind"),
        F.when(good, F.col("start")).alias("start"),
        F.when(good, F.col("start") + F.col("size")).alias("end"),
        F.when(good, F.regexp_replace("value", INNER, "")).alias("value"),
    )
    return written(spans, "secret-spans")


def _is(kind: Column | str, names: list[str]) -> Column:
    return F.col(kind).isin([k for k, (name, *_) in enumerate(KINDS) if name in names])


def _role(kind: str) -> Column:
    said = F.lit(None).cast("string")
    for k, (_, role, _, _) in enumerate(KINDS):
        said = F.when(F.col(kind) == k, role).otherwise(said)
    return said


def links(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Pairs of a weak span and any other span at most ``scope`` code points from it: (row, kind, start, end, other_*, gap).

    An interval join: spans, widened by half a scope, are listed under the stretches of the text that they
    touch, and meet under (document, stretch). A stretch holds no more spans than characters.
    """
    half = scope // 2 + 1
    first = F.greatest(F.col("start") - half, F.lit(0))
    listed = spans.where("kind is not null").withColumn(
        "stretch", F.explode(F.sequence(F.floor(first / scope), F.floor((F.col("end") + half) / scope)))
    )
    weak = listed.where(~_is("kind", STRONG)).drop("value", "doc_id")
    other = listed.select(
        "row", "stretch", F.col("kind").alias("other"), F.col("start").alias("o_start"), F.col("end").alias("o_end")
    )
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"), F.lit(0))
    met = weak.join(other, ["row", "stretch"]).withColumn("gap", gap).where(
        (F.col("gap") <= scope) & ((F.col("kind") != F.col("other")) | (F.col("start") != F.col("o_start")))
    )
    return met.drop("stretch").distinct()


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start) of the weak candidates that complementary parts confirm."""
    near = links(spans, scope).withColumn("role", _role("kind")).withColumn("other_role", _role("other"))
    inside = (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end")) & _is("other", STRONG)
    # parts that overlap are one part, not two that complete each other
    apart = (F.col("o_start") >= F.col("end")) | (F.col("start") >= F.col("o_end"))
    seen = near.groupBy("row", "kind", "role", "start").agg(
        F.max(inside).alias("inside"),
        F.max((F.col("other_role") == "identifier") & apart).alias("identifier"),
        F.max((F.col("other_role") == "secret") & apart).alias("secret"),
    )
    complete = (
        F.when(F.col("role") == "secret", F.col("identifier"))
        .when(F.col("role") == "identifier", F.col("secret"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return seen.where(~F.col("inside") & complete).select("row", "kind", "start")


def secret_spans(docs: DataFrame, scope: int = SCOPE, row: Column | None = None) -> DataFrame:
    """All reported spans (row, doc_id, kind, start, end, value); documents without any keep one row of nulls."""
    spans = candidates(docs, row)
    confirmed = linked(spans, scope).withColumn("confirmed", F.lit(True))
    weak = F.col("kind").isNotNull() & ~_is("kind", STRONG)
    checked = spans.join(confirmed, ["row", "kind", "start"], "left")
    dropped = weak & F.col("confirmed").isNull()
    return checked.select("row", "doc_id", *[F.when(~dropped, F.col(c)).alias(c) for c in ("kind", "start", "end", "value")])


def secret_digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each document: counts of the strong kinds, a digest of their spans, and all spans."""
    spans = secret_spans(docs, scope)
    found = spans.groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("found")
    )
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    shown = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    base = F.filter("found", lambda s: s["kind"] < len(STRONG))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(STRONG)],
        F.sha2(F.concat_ws(",", F.transform(base, shown)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", shown)).alias("spans"),
    )


def masked(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span, overlapping ones merged, replaced by ``mask``; n_chars follows the text.

    Other rows and columns stay as they are. The document's own number joins the spans to it.
    """
    rows = numbered(docs)
    spans = secret_spans(rows.select("row", "doc.doc_id", "doc.text"), scope, F.col("row")).where("kind is not null")
    furthest = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") > F.coalesce(F.max("end").over(furthest), F.lit(-1)), 1).otherwise(0)
    runs = spans.withColumn("_new", fresh).withColumn(
        "_run", F.sum("_new").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = runs.groupBy("row", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    text = F.col("doc.text")
    kept_from = lambda at: F.when(at == 0, F.lit(0)).otherwise(F.element_at("cuts", at)["end"])
    part = lambda cut, at: F.concat(
        F.substring(text, kept_from(at) + 1, cut["start"] - kept_from(at)), F.lit(mask)
    )
    last = F.element_at("cuts", -1)["end"]
    rebuilt = F.concat(F.array_join(F.transform("cuts", part), ""), F.substring(text, last + 1, F.length(text)))
    joined = rows.join(whole, "row", "left").withColumn("new", F.coalesce(rebuilt, text))
    shown = []
    for c, kind in docs.dtypes:
        if c == "text":
            shown.append(F.col("new").alias(c))
        elif c == "n_chars":
            shown.append(F.when(F.col("cuts").isNotNull(), F.length("new").cast(kind)).otherwise(F.col("doc.n_chars")).alias(c))
        else:
            shown.append(F.col(f"doc.`{c}`").alias(c))
    return joined.select(*shown)
