"""Triangles, clustering, census, similarity and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.graph.frame import Graph
from millrace.operators import ordered
from millrace.scratch import written


#: Owners up to which an item counts as rare: each of them then meets fewer than that many others by it.
RARE = 128
#: Items of an owner from which on its pairs are dealt out over partitions.
LARGE = 4096
#: Pairs that a partition counts, about.
PAIRS = 2_000_000


def once(graph: Graph) -> DataFrame:
    """Undirected simple edges, each once, as (a, b) with a < b."""
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.distinct()


def _degree(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def triangles(graph: Graph) -> DataFrame:
    """Each triangle once, as (a, b, c) with a < b < c.

    Edges point from the lower to the higher degree, which bounds every out-list by the square root of
    twice the edge count even for a hub. For each edge the two out-lists are intersected, so no wedge
    rows are made or shuffled.
    """
    pairs = written(once(graph), "pairs")
    degree = _degree(pairs)
    ranked = (
        pairs.join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a")
        .join(degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    )
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    pointed = written(
        ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")),
        "pointed",
    )
    outs = pointed.groupBy("u").agg(F.collect_list("v").alias("out"))
    third = (
        pointed.join(outs, "u")
        .join(outs.select(F.col("u").alias("v"), F.col("out").alias("out_v")), "v")
        .select("u", "v", F.explode(F.array_intersect("out", "out_v")).alias("w"))
    )
    corners = F.array_sort(F.array("u", "v", "w"))
    return third.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def triangle_counts(graph: Graph) -> DataFrame:
    """(id, triangles) of the vertices that are in one."""
    corners = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id"))
    return corners.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def local_clustering(graph: Graph) -> DataFrame:
    """Undirected: (id, degree, triangles, score), score = triangles / possible neighbour pairs."""
    degree = _degree(once(graph))
    joined = degree.join(triangle_counts(graph), "id", "left").fillna(0, ["triangles"])
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    score = F.when(F.col("degree") > 1, F.col("triangles") / possible).otherwise(0.0)
    return joined.select("id", "degree", "triangles", score.alias("score"))


def local_clustering_directed(graph: Graph) -> DataFrame:
    """(id, degree, links, score): directed links between neighbours over degree * (degree - 1)."""
    degree = _degree(once(graph))
    directed = graph.edges.where("src <> dst").select("src", "dst").distinct()
    ways = directed.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("ways")
    )
    tri = triangles(graph)
    opposite = tri.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("id"), F.col("b").alias("x"), F.col("c").alias("y")),
                F.struct(F.col("b").alias("id"), F.col("a").alias("x"), F.col("c").alias("y")),
                F.struct(F.col("c").alias("id"), F.col("a").alias("x"), F.col("b").alias("y")),
            )
        ).alias("t")
    ).select("t.*")
    links = opposite.join(ways, ["x", "y"]).groupBy("id").agg(F.sum("ways").alias("links"))
    joined = degree.join(links, "id", "left").fillna(0, ["links"])
    score = F.when(F.col("degree") > 1, F.col("links") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return joined.select("id", "degree", "links", score.alias("score"))


def average_clustering(graph: Graph) -> DataFrame:
    scores = local_clustering(graph)
    counted = graph.vertices.select("id").join(scores, "id", "left").fillna(0.0, ["score"])
    return counted.agg(F.count(F.lit(1)).alias("vertices"), F.avg("score").alias("average"))


def vertex_metrics(graph: Graph) -> DataFrame:
    """One row: vertices, edges, triplets, greatest degree and triplets, mean degree and density."""
    degree = graph.vertices.select("id").join(_degree(once(graph)), "id", "left").fillna(0, ["degree"])
    wedges = (F.col("degree") * (F.col("degree") - 1) / 2).cast("bigint")
    totals = degree.agg(
        F.count(F.lit(1)).alias("vertices"),
        (F.sum("degree") / 2).cast("bigint").alias("edges"),
        F.sum(wedges).alias("triplets"),
        F.max("degree").alias("max_degree"),
        F.max(wedges).alias("max_triplets"),
    )
    n = F.col("vertices")
    return totals.select(
        "*",
        F.when(n > 0, 2 * F.col("edges") / n).alias("average_degree"),
        F.when(n > 1, F.col("edges") / (n * (n - 1) / 2)).alias("density"),
    )


def global_clustering(graph: Graph) -> DataFrame:
    """One row: triplets, triangles and their ratio (three triplets close per triangle)."""
    closed = triangle_counts(graph).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("bigint").alias("triangles"))
    metrics = vertex_metrics(graph)
    joined = metrics.select("triplets").withColumn("triangles", closed.scalar())
    return joined.withColumn("score", F.when(F.col("triplets") > 0, 3 * F.col("triangles") / F.col("triplets")).otherwise(0.0))


def triadic_census(graph: Graph) -> DataFrame:
    """Undirected: how many vertex triples have 0, 1, 2 and 3 edges, from counts alone."""
    closed = triangle_counts(graph).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("bigint").alias("t"))
    counts = vertex_metrics(graph).select("vertices", "edges", "triplets").withColumn("t3", closed.scalar())
    n, m = F.col("vertices").cast("decimal(38,0)"), F.col("edges").cast("decimal(38,0)")
    wide = "decimal(38,0)"
    t3 = F.col("t3").cast(wide)
    t2 = F.col("triplets").cast(wide) - 3 * t3
    t1 = m * (n - 2) - 2 * t2 - 3 * t3
    # one of two neighbours is even and one of three is divisible by three, so each division is exact
    pairs = F.floor((n * (n - 1)).cast("decimal(30,0)") / F.lit(2).cast("decimal(1,0)")).cast(wide)
    every = F.floor((pairs * (n - 2)).cast("decimal(37,0)") / F.lit(3).cast("decimal(1,0)")).cast(wide)
    return counts.select(*[c.cast(wide).alias(f"t{i}") for i, c in enumerate((every - t1 - t2 - t3, t1, t2, t3))])


def edge_metrics(graph: Graph) -> DataFrame:
    """One row: how many wedges a triangle or rectangle search would look at, in all and at most per vertex.

    Edges point to the end of higher degree; a triangle search pairs out-edges, a rectangle search also
    pairs every out-edge with every in-edge.
    """
    pairs = written(once(graph), "pairs")
    degree = _degree(pairs)
    ranked = pairs.join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(
        degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b"
    )
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    ends = ranked.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("id"), up.cast("bigint").alias("o")),
                F.struct(F.col("b").alias("id"), (~up).cast("bigint").alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    sides = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum(1 - F.col("o")).alias("i"))
    narrow = (F.col("o") * (F.col("o") - 1) / 2).cast("bigint")
    wide = narrow + F.col("o") * F.col("i")
    return sides.agg(
        F.coalesce(F.sum(narrow), F.lit(0)).alias("triangle_triplets"),
        F.coalesce(F.sum(wide), F.lit(0)).alias("rectangle_triplets"),
        F.coalesce(F.max(narrow), F.lit(0)).alias("max_triangle_triplets"),
        F.coalesce(F.max(wide), F.lit(0)).alias("max_rectangle_triplets"),
    )


def _dyads(graph: Graph) -> DataFrame:
    """Connected pairs x < y with ``way``: 1 for x -> y only, 2 for y -> x only, 3 for both."""
    directed = graph.edges.where("src <> dst").select("src", "dst").distinct()
    way = F.when(F.col("src") < F.col("dst"), 1).otherwise(2)
    sides = directed.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), way.alias("way"))
    return sides.groupBy("x", "y").agg(F.sum("way").alias("way"))


def vertex_metrics_directed(graph: Graph) -> DataFrame:
    """One row: vertices, one-way and two-way edges, triplets and the greatest degrees."""
    dyads = _dyads(graph)
    near = dyads.select(
        F.explode(
            F.array(
                F.struct(F.col("x").alias("id"), (F.col("way") != 2).alias("o"), (F.col("way") != 1).alias("i")),
                F.struct(F.col("y").alias("id"), (F.col("way") != 1).alias("o"), (F.col("way") != 2).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    counted = near.groupBy("id").agg(F.count(F.lit(1)).alias("d"), F.count_if("o").alias("o"), F.count_if("i").alias("i"))
    each = graph.vertices.select("id").join(counted, "id", "left").fillna(0, ["d", "o", "i"])
    wedges = (F.col("d") * (F.col("d") - 1) / 2).cast("bigint")
    totals = each.agg(
        F.count(F.lit(1)).alias("vertices"), F.sum(wedges).alias("triplets"), F.max("d").alias("max_degree"),
        F.max("o").alias("max_out_degree"), F.max("i").alias("max_in_degree"), F.max(wedges).alias("max_triplets"),
    )
    ways = dyads.agg(F.struct(F.count_if(F.col("way") < 3).alias("one"), F.count_if(F.col("way") == 3).alias("two")).alias("w"))
    return totals.withColumn("_w", ways.scalar()).select(
        "vertices", F.col("_w.one").alias("one_way"), F.col("_w.two").alias("two_way"), "triplets", "max_degree",
        "max_out_degree", "max_in_degree", "max_triplets",
    )


# The sixteen triad classes in their usual order.
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def triadic_census_directed(graph: Graph) -> DataFrame:
    """(triad, n) for the sixteen classes of directed vertex triples.

    Triples joined in the middle only are counted from each vertex's numbers of outgoing, incoming and
    two-way neighbours; the corners of triangles are taken off, triangles are classed one by one, and
    triples with one edge or none follow from the totals.
    """
    dyads = written(_dyads(graph), "dyads")
    sides = dyads.select(
        F.explode(
            F.array(
                F.struct(F.col("x").alias("id"), F.element_at(F.array(*map(F.lit, "oim")), F.col("way").cast("int")).alias("k")),
                F.struct(F.col("y").alias("id"), F.element_at(F.array(*map(F.lit, "iom")), F.col("way").cast("int")).alias("k")),
            )
        ).alias("e")
    ).select("e.*")
    near = sides.groupBy("id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in "oim"])

    def pairs(k):
        return F.sum((F.col(k) * (F.col(k) - 1) / 2).cast("bigint"))

    wedges = near.agg(
        pairs("o").alias("oo"), pairs("i").alias("ii"), pairs("m").alias("mm"), F.sum(F.col("o") * F.col("i")).alias("io"),
        F.sum(F.col("m") * F.col("i")).alias("im"), F.sum(F.col("m") * F.col("o")).alias("mo"),
    )
    tri = triangles(graph)
    for x, y in ("ab", "ac", "bc"):
        tri = tri.join(dyads.select(F.col("x").alias(x), F.col("y").alias(y), F.col("way").cast("int").alias(x + y)), [x, y])

    def side(way, first):
        return F.element_at(F.array(*map(F.lit, "oim" if first else "iom")), F.col(way))

    corners = [(("ab", True), ("ac", True)), (("ab", False), ("bc", True)), (("ac", False), ("bc", False))]
    kinds = F.array(*[F.array_join(F.array_sort(F.array(side(*p), side(*q))), "") for p, q in corners])
    shapes = tri.select(kinds.alias("k")).select("k", F.size(F.filter(F.flatten(F.transform("k", lambda c: F.split(c, ""))), lambda c: c == "m")).alias("m"))
    has = lambda c: F.array_contains("k", c)
    name = (
        F.when(F.col("m") == 6, "300").when(F.col("m") == 4, "210")
        .when(F.col("m") == 2, F.when(has("oo"), "120D").when(has("ii"), "120U").otherwise("120C"))
        .otherwise(F.when(has("oo"), "030T").otherwise("030C"))
    )
    classes = shapes.groupBy(name.alias("triad"), "k").agg(F.count(F.lit(1)).alias("n"))
    # a few dozen rows: triangle classes by their corners
    closed: dict[str, int] = dict.fromkeys(TRIADS, 0)
    corner_counts: dict[str, int] = {}
    for row in classes.collect():
        closed[row["triad"]] += row["n"]
        for corner in row["k"]:
            corner_counts[corner] = corner_counts.get(corner, 0) + row["n"]
    total = {k: v or 0 for k, v in wedges.first().asDict().items()}
    opened = {kind: n - corner_counts.get(kind, 0) for kind, n in total.items()}
    census = dict(closed)
    census |= {"021D": opened["oo"], "021U": opened["ii"], "021C": opened["io"], "111D": opened["im"], "111U": opened["mo"], "201": opened["mm"]}
    ways = dyads.agg(F.count_if(F.col("way") < 3).alias("one"), F.count_if(F.col("way") == 3).alias("two")).first()
    n = graph.vertices.count()
    two_way = {"111D": 1, "111U": 1, "201": 2, "120D": 1, "120U": 1, "120C": 1, "210": 2, "300": 3}
    edges = {t: (2 if t in ("021D", "021U", "021C", "111D", "111U", "201") else 3) for t in TRIADS[3:]}
    census["102"] = ways["two"] * (n - 2) - sum(two_way.get(t, 0) * census[t] for t in TRIADS[3:])
    census["012"] = ways["one"] * (n - 2) - sum((edges[t] - two_way.get(t, 0)) * census[t] for t in TRIADS[3:])
    census["003"] = n * (n - 1) * (n - 2) // 6 - sum(census[t] for t in TRIADS[1:])
    spark = graph.vertices.sparkSession
    return spark.createDataFrame([(t, census[t]) for t in TRIADS], "triad string, n bigint")


def neighbour_similarity(graph: Graph, measure: str, at_least: float) -> DataFrame:
    """Vertex pairs (a < b) by shared neighbours: see :func:`similar_sets` for the measures."""
    pairs = written(once(graph), "pairs")
    both = pairs.select(F.col("a").alias("owner"), F.col("b").alias("item")).unionByName(
        pairs.select(F.col("b").alias("owner"), F.col("a").alias("item"))
    )
    return similar_sets(both, measure, at_least)


def project_bipartite(edges: DataFrame, side: str, min_shared: int) -> DataFrame:
    """Projection of bipartite edges (top, bottom) onto one side: pairs sharing ``min_shared`` vertices or more."""
    other = "bottom" if side == "top" else "top"
    members = edges.select(F.col(side).alias("owner"), F.col(other).alias("item")).distinct()
    return similar_sets(members, "shared", min_shared).select("a", "b", "shared")


def similar_sets(members: DataFrame, measure: str, at_least: float) -> DataFrame:
    """Pairs of owners (a < b) whose item sets score ``at_least`` or more, out of distinct (owner, item).

    ``shared`` is the number of common items, ``jaccard`` common over all, ``adamic_adar`` the sum of
    1 / ln(frequency) over common items. Columns: a, b, shared, distinct, score.

    Items are taken from the rarest on. An item with up to ``RARE`` owners is offered by all of them, which is
    at most ``RARE`` / 2 pairs a row. Of its commoner items an owner offers those from which on the rest could
    still reach the score, so a hub is hardly ever offered. The first common item of a pair that reaches
    the score is offered by both, so nothing is lost. A pair is counted in the partition of its first owner, to
    which every item sends its other owners as one array; a pair that could not reach the score with what the two
    hold back goes no further. Any other common item comes after the earlier of the two cuts, so looking that
    owner's few held-back items up in the other set completes the count. No hub is collected.
    """
    if at_least <= 0:
        raise ValueError("the least score must be positive")
    members = written(members, "members")
    frequency = members.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    weight = 1.0 / F.ln(F.greatest(F.col("freq"), F.lit(2)).cast("double"))
    weighed = measure == "adamic_adar"
    w = weight if weighed else F.lit(1.0)
    known = written(members.join(frequency, "item").select("owner", "item", "freq", w.alias("w")), "known")
    rare = F.col("freq") <= RARE
    totals = known.groupBy("owner").agg(
        F.count(F.lit(1)).alias("size"), F.sum("w").alias("all"), F.count_if(rare).alias("rare_n"),
        F.coalesce(F.sum(F.when(rare, F.col("w"))), F.lit(0.0)).alias("rare_w"),
    )
    share = F.greatest(F.ceil(F.lit(float(at_least)) * F.col("size") - 1e-9), F.lit(1))
    needed = F.lit(float(at_least)) if weighed else (share if measure == "jaccard" else F.lit(max(1, int(at_least)))).cast("double")
    able = totals.withColumn("needed", needed).where(F.col("all") >= F.col("needed") - 1e-9)
    common = known.where(~rare).join(able, "owner")
    ranked = ordered.running(common, ["owner"], ["freq", "item"], {"before": ("sum", "w")}, exclusive=True)
    rest = F.col("all") - F.col("rare_w") - F.coalesce("before", F.lit(0.0))
    ranked = written(ranked.select("owner", "item", "freq", "w", (rest >= F.col("needed") - 1e-9).alias("offered")), "ranked")
    cuts = ranked.where("offered").groupBy("owner").agg(F.max(F.struct("freq", "item")).alias("cut"), F.sum("w").alias("common_w"))
    # a cut without an item lies behind all rare items and before the common ones
    whole = F.struct(F.lit(RARE).cast("bigint").alias("freq"), F.lit(None).cast(members.schema["item"].dataType).alias("item"))
    held = F.greatest(F.col("all") - F.col("rare_w") - F.coalesce("common_w", F.lit(0.0)), F.lit(0.0))
    owners = written(able.join(cuts, "owner", "left").select("owner", "size", held.alias("held"), F.coalesce("cut", whole).alias("cut")), "owners")
    offered = known.where(rare).select("owner", "item", "freq", "w").unionByName(ranked.where("offered").select("owner", "item", "freq", "w"))
    met = _met(offered.join(owners.select("owner", "size", "held"), "owner"), measure, at_least)
    counted = met.join(_side(owners, "a"), "a").join(_side(owners, "b"), "b")
    a_first = F.col("of_a.cut") <= F.col("of_b.cut")
    still = F.when(a_first, F.col("of_a.held")).otherwise(F.col("of_b.held"))
    sizes = F.col("of_a.size") + F.col("of_b.size")
    # shared / (size_a + size_b - shared) >= t
    required = F.lit(at_least / (1 + at_least)) * sizes if measure == "jaccard" else F.lit(float(at_least))
    reached = F.col("sum") if weighed else F.col("n")
    candidates = written(
        counted.where(reached + still >= required - 1e-9).select(
            "a", "b", "n", "sum", sizes.alias("sizes"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("owner"),
            F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("_other"), (still > 0).alias("open"),
        ),
        "candidates",
    )
    back = ranked.where("NOT offered").select("owner", "item", "w")
    lookups = candidates.where("open").select("a", "b", "owner", "_other")
    more = lookups.join(back, "owner").select("a", "b", F.col("_other").alias("owner"), "item", "w").join(members, ["owner", "item"])
    extra = more.groupBy("a", "b").agg(F.count(F.lit(1)).alias("more"), F.sum("w").alias("more_sum"))
    scored = candidates.join(extra, ["a", "b"], "left").select(
        "a", "b", "sizes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("shared"),
        (F.col("sum") + F.coalesce("more_sum", F.lit(0.0))).alias("weight"),
    )
    distinct = F.col("sizes") - F.col("shared")
    score = {"jaccard": F.col("shared") / distinct, "shared": F.col("shared").cast("double"), "adamic_adar": F.col("weight")}
    out = scored.select("a", "b", "shared", distinct.alias("distinct"), score[measure].alias("score"))
    return out.where(F.col("score") >= at_least - 1e-9)


def _side(owners: DataFrame, name: str) -> DataFrame:
    return owners.select(F.col("owner").alias(name), F.struct("size", "held", "cut").alias(f"of_{name}"))


def _met(offers: DataFrame, measure: str, at_least: float) -> DataFrame:
    """(a, b, n, sum): owners a < b that offer ``n`` common items, without most pairs that cannot reach the score.

    Owners of an item are collected in chunks of about ``RARE``; pairs of a large owner are dealt out by their other owner.
    """
    chunks = F.ceil(F.col("freq") / RARE).cast("int")
    offers = offers.withColumn("_chunks", chunks).withColumn("_chunk", F.pmod(F.xxhash64("owner"), F.col("_chunks")).cast("int"))
    offers = written(offers, "offers")
    entry = F.struct("owner", "size", "held")
    few = offers.where("_chunks = 1").groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias("list"), F.first("w").alias("w"))
    left = few.select("w", "list", F.posexplode("list").alias("_i", "of")).select(
        F.col("of").alias("of"), "w", F.slice("list", F.col("_i") + 2, F.greatest(F.size("list") - F.col("_i") - 1, F.lit(0))).alias("others")
    )
    many = offers.where("_chunks > 1")
    listed = many.groupBy("item", "_chunk").agg(F.collect_list(entry).alias("list"))
    asked = many.select("item", "w", entry.alias("of"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    right = asked.join(listed, ["item", "_chunk"]).select("of", "w", F.filter("list", lambda x: x["owner"] > F.col("of.owner")).alias("others"))
    rows = left.unionByName(right).where(F.size("others") > 0)
    held = F.greatest(F.col("of.held"), F.array_max(F.col("others.held")))
    if measure == "jaccard":
        least = F.lit(at_least / (1 + at_least)) * (F.col("of.size") + F.array_min(F.col("others.size"))) - held
    else:
        least = F.lit(float(at_least)) - held
    parts = F.ceil(F.col("of.size") / LARGE).cast("int")
    rows = rows.select(F.col("of.owner").alias("a"), "w", least.alias("least"), F.col("others.owner").alias("bs"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), parts.alias("_parts"))
    dealt = F.filter("bs", lambda b: F.pmod(F.xxhash64(b), F.col("_parts")) == F.col("_part"))
    rows = rows.withColumn("bs", F.when(F.col("_parts") > 1, dealt).otherwise(F.col("bs"))).drop("_parts")
    # no owner of a row meets more than the other owners of its item
    pairs = offers.agg(F.sum(F.least("freq", F.lit(RARE * 64)))).first()[0] or 0
    count = max(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // (2 * PAIRS)))
    together = rows.repartition(count, "a", "_part").select("a", "_part", "w", "least", F.explode("bs").alias("b"))
    counted = together.groupBy("a", "_part", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum"), F.max("least").alias("least"))
    reached = F.col("sum") if measure == "adamic_adar" else F.col("n")
    return written(counted.where(reached >= F.col("least") - 1e-9).select("a", "b", "n", "sum"), "met")
