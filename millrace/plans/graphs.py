"""Graph queries on the succession graph: part -> part of the next line of the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.graph import generators, local, loops
from millrace.graph.frame import Graph
from millrace.plans.registry import query
from millrace.scratch import written


def _succession(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    here = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    following = lines.withColumnRenamed("l_partkey", "dst")
    return here.join(following, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def _graph(t, value=None):
    """The graph over all parts, edges weighted 1 to 10 by their ends."""
    weight = (1 + F.pmod(F.col("src") + F.col("dst"), F.lit(10))).cast("double")
    edges = written(_succession(t).withColumn("value", weight), "succession")
    vertices = t.part.select(F.col("p_partkey").alias("id"))
    return Graph(vertices.withColumn("value", F.col("id") if value is None else value), edges)


_EDGES = """e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CAST(1 + (a.l_partkey + b.l_partkey) % 10 AS DOUBLE) AS w
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
  v AS (SELECT p_partkey AS id FROM part)"""
_PAIRS = f"""{_EDGES}, p AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
  n AS MATERIALIZED (SELECT a AS id, b AS near FROM p UNION ALL SELECT b, a FROM p),
  d AS MATERIALIZED (SELECT id, CAST(count(*) AS BIGINT) AS degree FROM n GROUP BY 1)"""
_TRI = f"""{_PAIRS}, tri AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b),
  tc AS MATERIALIZED (SELECT id, CAST(count(*) AS BIGINT) AS triangles FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1)"""


@query(
    "graph_degrees",
    f"""WITH {_PAIRS} SELECT id, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) AS BIGINT) AS in_degree,
        CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM v LEFT JOIN (SELECT src AS id, count(*) AS o FROM e WHERE src <> dst GROUP BY 1) USING (id)
        LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e WHERE src <> dst GROUP BY 1) USING (id) LEFT JOIN d USING (id)""",
)
def graph_degrees(t):
    return _graph(t).simplify().degrees()


@query(
    "graph_edge_degrees",
    f"""WITH {_PAIRS} SELECT src, dst, x.degree AS src_degree, y.degree AS dst_degree FROM e JOIN d x ON src = x.id JOIN d y ON dst = y.id WHERE src <> dst""",
)
def graph_edge_degrees(t):
    return _graph(t).simplify().edge_degrees()


@query("graph_simplify", f"WITH {_PAIRS} SELECT id AS src, near AS dst FROM n")
def graph_simplify(t):
    return _graph(t).simplify(undirected=True).edges.select("src", "dst")


@query(
    "graph_reduce_neighbours",
    f"""WITH {_EDGES} SELECT id, CAST(count(*) AS BIGINT) AS n, min(other) AS low, round(sum(w), 2) AS weight FROM
        (SELECT src AS id, dst AS other, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1""",
)
def graph_reduce_neighbours(t):
    """Neighbour and edge values reduced in both directions."""
    return _graph(t).reduce_neighbours(
        "all", n=F.count(F.lit(1)), low=F.min("neighbour_value"), weight=F.round(F.sum("edge_value"), 2)
    )


@query(
    "graph_subgraph_triplets",
    f"""WITH {_EDGES} SELECT src, dst, x.p_size AS src_value, y.p_size AS dst_value FROM e JOIN part x ON src = x.p_partkey
        JOIN part y ON dst = y.p_partkey WHERE x.p_size >= 25 AND y.p_size >= 25 AND w > 4""",
)
def graph_subgraph_triplets(t):
    sizes = t.part.select(F.col("p_partkey").alias("id"), "p_size")
    graph = _graph(t).join_vertices(sizes, F.col("p_size").cast("bigint"))
    part = graph.subgraph(vertex=F.col("value") >= 25, edge=F.col("value") > 4)
    rows = part.triplets()
    return rows.select("src", "dst", F.col("src_value").cast("int").alias("src_value"), F.col("dst_value").cast("int").alias("dst_value"))


@query(
    "graph_set_operations",
    f"""WITH {_EDGES}, heavy AS (SELECT src, dst FROM e WHERE w > 5), light AS (SELECT src, dst FROM e WHERE w < 8)
        SELECT 'union' AS what, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM heavy UNION ALL SELECT * FROM light)
        UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM heavy INTERSECT SELECT * FROM light)
        UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM e WHERE w <= 5)
        UNION ALL SELECT 'invalid', 0 UNION ALL SELECT 'reversed', count(*) FROM e""",
)
def graph_set_operations(t):
    graph = _graph(t)
    heavy, light = graph.subgraph(edge=F.col("value") > 5), graph.subgraph(edge=F.col("value") < 8)
    counted = {
        "union": heavy.union(light).edges,
        "intersect": heavy.intersect(light).edges,
        "removed": graph.remove_edges(heavy.edges).edges,
        "invalid": graph.invalid_edges(),
        "reversed": graph.reverse().edges,
    }
    frames = [df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n")) for name, df in counted.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query(
    "graph_summarize",
    """WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
         ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
       SELECT x.p_brand AS src, y.p_brand AS dst, CAST(count(*) AS BIGINT) AS n FROM e JOIN part x ON src = x.p_partkey
       JOIN part y ON dst = y.p_partkey GROUP BY ALL""",
)
def graph_summarize(t):
    """Parts grouped by brand."""
    vertices = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    edges = _succession(t).withColumn("value", F.lit(1))
    small = Graph(vertices, edges).summarize()
    names = small.vertices.select("id", F.col("value.value").alias("brand"))
    joined = small.edges.join(names.withColumnRenamed("brand", "a"), F.col("src") == F.col("id")).drop("id")
    joined = joined.join(names.withColumnRenamed("brand", "b"), F.col("dst") == F.col("id"))
    return joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value.n").alias("n"))


@query("graph_triangles", f"WITH {_TRI} SELECT a, b, c FROM tri")
def graph_triangles(t):
    return local.triangles(_graph(t))


@query(
    "graph_local_cc",
    f"""WITH {_TRI} SELECT id, degree, coalesce(triangles, 0) AS triangles,
        round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 9) AS score FROM d LEFT JOIN tc USING (id)""",
)
def graph_local_cc(t):
    return local.local_clustering(_graph(t)).withColumn("score", F.round("score", 9))


@query(
    "graph_local_cc_directed",
    f"""WITH {_PAIRS}, s AS (SELECT src, dst FROM e WHERE src <> dst),
        l AS (SELECT x.id, CAST(count(*) AS BIGINT) AS links FROM n x JOIN s ON s.src = x.near JOIN n y ON y.id = x.id AND y.near = s.dst GROUP BY 1)
        SELECT id, degree, coalesce(links, 0) AS links,
        round(CASE WHEN degree > 1 THEN coalesce(links, 0) / (degree * (degree - 1)) ELSE 0 END, 9) AS score FROM d LEFT JOIN l USING (id)""",
)
def graph_local_cc_directed(t):
    return local.local_clustering_directed(_graph(t)).withColumn("score", F.round("score", 9))


@query(
    "graph_average_cc",
    f"""WITH {_TRI} SELECT CAST(count(*) AS BIGINT) AS vertices, round(avg(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END), 9) AS average
        FROM v LEFT JOIN d USING (id) LEFT JOIN tc USING (id)""",
)
def graph_average_cc(t):
    return local.average_clustering(_graph(t)).withColumn("average", F.round("average", 9))


@query(
    "graph_global_cc",
    f"""WITH {_TRI} SELECT triplets, triangles, round(3 * triangles / triplets, 9) AS score FROM
        (SELECT CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS triplets FROM d), (SELECT CAST(count(*) AS BIGINT) AS triangles FROM tri)""",
)
def graph_global_cc(t):
    return local.global_clustering(_graph(t)).withColumn("score", F.round("score", 9))


@query(
    "graph_vertex_metrics",
    f"""WITH {_PAIRS}, f AS (SELECT id, coalesce(degree, 0) AS degree FROM v LEFT JOIN d USING (id))
        SELECT CAST(count(*) AS BIGINT) AS vertices, CAST(sum(degree) // 2 AS BIGINT) AS edges, CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS triplets,
        CAST(max(degree) AS BIGINT) AS max_degree, CAST(max(degree * (degree - 1) // 2) AS BIGINT) AS max_triplets,
        round(sum(degree) / count(*), 9) AS average_degree, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density FROM f""",
)
def graph_vertex_metrics(t):
    out = local.vertex_metrics(_graph(t))
    return out.withColumn("average_degree", F.round("average_degree", 9)).withColumn("density", F.round("density", 9))


@query(
    "graph_triadic_census",
    f"""WITH {_TRI}, k AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM p) AS m, (SELECT count(*) FROM tri) AS t3,
          (SELECT sum(degree * (degree - 1) // 2) FROM d) AS w),
        q AS (SELECT *, w - 3 * t3 AS t2, m * (n - 2) - 2 * (w - 3 * t3) - 3 * t3 AS t1 FROM k)
        SELECT CAST(n * (n - 1) * (n - 2) // 6 - t1 - t2 - t3 AS BIGINT) AS t0, CAST(t1 AS BIGINT) AS t1, CAST(t2 AS BIGINT) AS t2, CAST(t3 AS BIGINT) AS t3 FROM q""",
)
def graph_triadic_census(t):
    return local.triadic_census(_graph(t)).select(*[F.col(f"t{i}").cast("bigint").alias(f"t{i}") for i in range(4)])


@query(
    "graph_edge_metrics",
    f"""WITH {_PAIRS}, o AS (SELECT p.a, p.b, (x.degree, p.a) < (y.degree, p.b) AS up FROM p JOIN d x ON x.id = p.a JOIN d y ON y.id = p.b),
        s AS (SELECT id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(1 - o) AS BIGINT) AS i FROM
          (SELECT a AS id, up::INT AS o FROM o UNION ALL SELECT b, (NOT up)::INT FROM o) GROUP BY 1)
        SELECT CAST(sum(o * (o - 1) // 2) AS BIGINT) AS triangle_triplets, CAST(sum(o * (o - 1) // 2 + o * i) AS BIGINT) AS rectangle_triplets,
          CAST(max(o * (o - 1) // 2) AS BIGINT) AS max_triangle_triplets, CAST(max(o * (o - 1) // 2 + o * i) AS BIGINT) AS max_rectangle_triplets FROM s""",
)
def graph_edge_metrics(t):
    return local.edge_metrics(_graph(t))


@query(
    "graph_vertex_metrics_directed",
    f"""WITH {_PAIRS}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), o AS (SELECT src AS id, count(*) AS o FROM s GROUP BY 1),
        i AS (SELECT dst AS id, count(*) AS i FROM s GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS vertices, CAST(2 * (SELECT count(*) FROM p) - (SELECT count(*) FROM s) AS BIGINT) AS one_way,
          CAST((SELECT count(*) FROM s) - (SELECT count(*) FROM p) AS BIGINT) AS two_way,
          CAST(sum(coalesce(degree, 0) * (coalesce(degree, 0) - 1) // 2) AS BIGINT) AS triplets, CAST(max(degree) AS BIGINT) AS max_degree,
          CAST(max(o) AS BIGINT) AS max_out_degree, CAST(max(i) AS BIGINT) AS max_in_degree, CAST(max(degree * (degree - 1) // 2) AS BIGINT) AS max_triplets
        FROM v LEFT JOIN d USING (id) LEFT JOIN o USING (id) LEFT JOIN i USING (id)""",
)
def graph_vertex_metrics_directed(t):
    return local.vertex_metrics_directed(_graph(t))


@query("graph_triadic_census_directed")
def graph_triadic_census_directed(t):
    """Sixteen counts; checked against full enumeration in the tests."""
    return local.triadic_census_directed(_graph(t))


@query(
    "graph_euclidean_weights",
    """WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
         ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
       SELECT src, dst, round(sqrt((x.p_size - y.p_size) ** 2 + (x.p_retailprice / 100 - y.p_retailprice / 100) ** 2), 6) AS weight
       FROM e JOIN part x ON src = x.p_partkey JOIN part y ON dst = y.p_partkey""",
)
def graph_euclidean_weights(t):
    """Edges weighted by the distance of their ends."""
    point = F.struct(F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    vertices = t.part.select(F.col("p_partkey").alias("id"), point.alias("value"))
    rows = Graph(vertices, _succession(t).withColumn("value", F.lit(None).cast("double"))).triplets()
    gap = F.pow(F.col("src_value.x") - F.col("dst_value.x"), 2) + F.pow(F.col("src_value.y") - F.col("dst_value.y"), 2)
    return rows.select("src", "dst", F.round(F.sqrt(gap), 6).alias("weight"))


_SHARED = """s AS MATERIALIZED (SELECT x.id AS a, y.id AS b, CAST(count(*) AS BIGINT) AS shared, sum(1 / ln(m.degree)) AS aa
  FROM n x JOIN n y ON x.near = y.near AND x.id < y.id JOIN d m ON m.id = x.near GROUP BY ALL)"""


@query(
    "graph_jaccard",
    f"""WITH {_PAIRS}, {_SHARED} SELECT a, b, shared, x.degree + y.degree - shared AS "distinct", round(shared / (x.degree + y.degree - shared), 9) AS score
        FROM s JOIN d x ON a = x.id JOIN d y ON b = y.id WHERE shared / (x.degree + y.degree - shared) >= 0.1 - 1e-9""",
)
def graph_jaccard(t):
    return local.neighbour_similarity(_graph(t), "jaccard", 0.1).withColumn("score", F.round("score", 9))


@query(
    "graph_adamic_adar",
    f"""WITH {_PAIRS}, {_SHARED} SELECT a, b, round(aa, 7) AS score FROM s WHERE aa >= 1.5 - 1e-9""",
)
def graph_adamic_adar(t):
    return local.neighbour_similarity(_graph(t), "adamic_adar", 1.5).select("a", "b", F.round("score", 7).alias("score"))


@query(
    "bipartite_projection",
    """WITH m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
       SELECT x.p AS a, y.p AS b, CAST(count(*) AS BIGINT) AS shared FROM m x JOIN m y ON x.o = y.o AND x.p < y.p GROUP BY ALL HAVING count(*) >= 2""",
)
def bipartite_projection(t):
    """Parts that share at least two orders."""
    edges = t.lineitem.select(F.col("l_partkey").alias("top"), F.col("l_orderkey").alias("bottom"))
    return local.project_bipartite(edges, "top", 2)


@query(
    "graph_connected_components",
    f"""WITH RECURSIVE {_EDGES}, both_ways AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        c(id, component) USING KEY (id) AS (SELECT id, id FROM v UNION
          SELECT b.dst, min(c.component) FROM c JOIN both_ways b ON c.id = b.src JOIN recurring.c r ON r.id = b.dst
          WHERE c.component < r.component GROUP BY b.dst)
        SELECT id, component FROM c""",
)
def graph_connected_components(t):
    return loops.connected_components(_graph(t))


@query(
    "graph_minimum_propagation",
    f"""WITH RECURSIVE {_EDGES}, c(id, value) USING KEY (id) AS (SELECT id, id FROM v UNION
          SELECT e.dst, min(c.value) FROM c JOIN e ON c.id = e.src JOIN recurring.c r ON r.id = e.dst WHERE c.value < r.value GROUP BY e.dst)
        SELECT id, value FROM c""",
)
def graph_minimum_propagation(t):
    """The vertex-centric form, along directed edges."""
    return loops.propagate_minimum(_graph(t))


def _round(i):
    return f"""v{i} AS MATERIALIZED (SELECT x.id, least(x.value, min(y.value)) AS value FROM v{i - 1} x LEFT JOIN e ON e.dst = x.id
      LEFT JOIN v{i - 1} y ON y.id = e.src GROUP BY x.id, x.value)"""


@query(
    "graph_scatter_gather",
    f"WITH {_EDGES}, v0 AS (SELECT id, id AS value FROM v), {_round(1)}, {_round(2)}, {_round(3)} SELECT id, value FROM v3",
)
def graph_scatter_gather(t):
    """Three rounds of sending the smallest id seen to the out-neighbours."""
    return loops.scatter_gather(
        _graph(t), F.col("src_value"), F.min("message"), F.least("value", "message"), 3
    )


@query(
    "graph_gather_sum_apply",
    f"""WITH RECURSIVE {_EDGES}, c(id, value) USING KEY (id) AS (SELECT id, id FROM v UNION
          SELECT e.dst, min(c.value) FROM c JOIN e ON c.id = e.src JOIN recurring.c r ON r.id = e.dst WHERE c.value < r.value GROUP BY e.dst)
        SELECT id, value FROM c""",
)
def graph_gather_sum_apply(t):
    """The smallest id from which a vertex can be reached, gathered from in-neighbours until nothing changes."""
    return loops.gather_sum_apply(_graph(t), F.col("src_value"), F.min("gathered"), F.least("value", "gathered"))


@query(
    "graph_sssp",
    f"""WITH RECURSIVE {_EDGES}, c(id, value) USING KEY (id) AS (
          SELECT id, CASE WHEN id = (SELECT min(src) FROM e) THEN 0.0::DOUBLE ELSE 1.7976931348623157e308::DOUBLE END FROM v UNION
          SELECT e.dst, min(c.value + e.w) FROM c JOIN e ON c.id = e.src JOIN recurring.c r ON r.id = e.dst
          WHERE c.value < 1e300 AND c.value + e.w < r.value GROUP BY e.dst)
        SELECT id, value FROM c""",
)
def graph_sssp(t):
    graph = _graph(t)
    source = graph.edges.agg(F.min("src")).scalar()
    return loops.shortest_paths(graph, source)


@query(
    "graph_transitive_closure",
    """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders
         UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
       p(src, dst) AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src) SELECT src, dst FROM p""",
)
def graph_transitive_closure(t):
    """Order -> customer -> nation -> region."""

    def pairs(df, a, x, b, y):
        return df.select(
            F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst")
        )

    edges = pairs(t.orders, "o", "o_orderkey", "c", "o_custkey")
    edges = edges.unionByName(pairs(t.customer, "c", "c_custkey", "n", "c_nationkey"))
    return loops.transitive_closure(edges.unionByName(pairs(t.nation, "n", "n_nationkey", "r", "n_regionkey")))


def _rank_sql(rounds):
    out = [f"WITH {_EDGES}, f AS MATERIALIZED (SELECT src, count(*) AS fan FROM e GROUP BY 1), "
           "k AS (SELECT count(*) AS n FROM v), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, k)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""r{i} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g, 0) + coalesce(lost, 0) / n) AS rank FROM v
            LEFT JOIN (SELECT e.dst AS id, sum(rank / fan) AS g FROM e JOIN r{i - 1} ON id = src JOIN f ON f.src = e.src GROUP BY 1) USING (id), k,
            (SELECT sum(rank) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM f)))""")
    return ", ".join(out) + f" SELECT id, round(rank * 1000000, 5) AS rank FROM r{rounds}"


@query("graph_pagerank", _rank_sql(5))
def graph_pagerank(t):
    """Five rounds, in millionths."""
    ranks = loops.page_rank(_graph(t), 0.85, 5)
    return ranks.select("id", F.round(F.col("rank") * 1000000, 5).alias("rank"))


def _hits_sql(rounds):
    out = [f"WITH {_EDGES}, h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f"""x{i} AS MATERIALIZED (SELECT dst AS id, sum(hub) AS s FROM e JOIN h{i - 1} ON id = src GROUP BY 1),
          a{i} AS MATERIALIZED (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM x{i}) AS authority FROM x{i}),
          y{i} AS MATERIALIZED (SELECT src AS id, sum(authority) AS s FROM e JOIN a{i} ON id = dst GROUP BY 1),
          h{i} AS MATERIALIZED (SELECT v.id, coalesce(s, 0) / (SELECT sqrt(sum(s * s)) FROM y{i}) AS hub, coalesce(authority, 0) AS authority
            FROM v LEFT JOIN y{i} USING (id) LEFT JOIN a{i} USING (id))""")
    return ", ".join(out) + f" SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h{rounds}"


@query("graph_hits", _hits_sql(4))
def graph_hits(t):
    out = loops.hits(_graph(t), 4)
    return out.select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def _labels_sql(rounds):
    out = [f"WITH {_EDGES}, l0 AS MATERIALIZED (SELECT id, id AS value FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f"""l{i} AS MATERIALIZED (SELECT v.id, coalesce(w.value, o.value) AS value FROM v JOIN l{i - 1} o USING (id) LEFT JOIN
          (SELECT dst AS id, arg_max(value, (c, value)) AS value FROM
            (SELECT dst, value, count(*) AS c FROM e JOIN l{i - 1} ON id = src GROUP BY ALL) GROUP BY 1) w USING (id))""")
    return ", ".join(out) + f" SELECT id, value FROM l{rounds}"


@query("graph_label_prop", _labels_sql(3))
def graph_label_prop(t):
    return loops.label_propagation(_graph(t), 3)


def _community_sql(rounds):
    out = [f"WITH {_EDGES}, l0 AS MATERIALIZED (SELECT id, id AS label, 1.0::DOUBLE AS score FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f"""l{i} AS MATERIALIZED (SELECT o.id, coalesce(w.label, o.label) AS label,
            coalesce(w.best - CASE WHEN w.label <> o.label THEN 0.5 / {i} ELSE 0 END, o.score) AS score FROM l{i - 1} o LEFT JOIN
          (SELECT dst AS id, arg_max(label, (points, -label)) AS label, arg_max(best, (points, -label)) AS best FROM
            (SELECT dst, label, sum(score * w) AS points, max(score * w) AS best FROM e JOIN l{i - 1} ON id = src GROUP BY ALL) GROUP BY 1) w ON w.id = o.id)""")
    return ", ".join(out) + f" SELECT id, label FROM l{rounds}"


@query("graph_community", _community_sql(3))
def graph_community(t):
    return loops.community_detection(_graph(t), 3, 0.5)


def _counts(name, made):
    vertices, edges = made
    total = edges.agg(F.lit(name).alias("graph"), F.count(F.lit(1)).alias("edges"), F.count_distinct("src", "dst").alias("pairs"),
                      F.sum((F.col("src") * 31 + F.col("dst")).cast("bigint")).alias("mix"))
    return total.withColumn("vertices", vertices.agg(F.count(F.lit(1))).scalar())


@query(
    "graph_generators",
    """WITH k AS (SELECT count(*) AS n FROM customer), v AS (SELECT unnest(generate_series(0, n - 1)) AS id, n FROM k),
       cyc AS (SELECT id AS src, (id + 1) % n AS dst, n FROM v UNION ALL SELECT (id + 1) % n, id, n FROM v),
       pth AS (SELECT id AS src, id + 1 AS dst, n FROM v WHERE id < n - 1 UNION ALL SELECT id + 1, id, n FROM v WHERE id < n - 1),
       str AS (SELECT 0 AS src, id AS dst, n FROM v WHERE id > 0 UNION ALL SELECT id, 0, n FROM v WHERE id > 0),
       sng AS (SELECT xor(id, 1) AS dst, id AS src, 2 * m AS n FROM (SELECT unnest(generate_series(0, 2 * n - 1)) AS id, n AS m FROM k)),
       g AS (SELECT 'cycle' AS graph, src, dst, n FROM cyc UNION ALL SELECT 'path', src, dst, n FROM pth
             UNION ALL SELECT 'star', src, dst, n FROM str UNION ALL SELECT 'singleton', src, dst, n FROM sng)
       SELECT graph, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT (src, dst)) AS BIGINT) AS pairs, CAST(sum(src * 31 + dst) AS BIGINT) AS mix,
              CAST(max(n) AS BIGINT) AS vertices FROM g GROUP BY 1""",
)
def graph_generators(t):
    """As many vertices as there are customers."""
    n = t.customer.count()
    out = _counts("cycle", generators.cycle(t.spark, n))
    for name, made in {
        "path": generators.path(t.spark, n),
        "star": generators.star(t.spark, n),
        "singleton": generators.singleton_edges(t.spark, n),
    }.items():
        out = out.unionByName(_counts(name, made))
    return out


@query("graph_rmat")
def graph_rmat(t):
    """A random power-law graph with an edge per order and its degree distribution."""
    n = t.orders.count()
    _, edges = generators.rmat(t.spark, max(2, n.bit_length() - 2), n, seed=11)
    # drawn once: the vertices read the edges, and degrees the simple ones three times
    graph = Graph.from_edges(written(edges, "rmat"))
    simple = Graph(graph.vertices, written(graph.simplify().edges, "simple"))
    return simple.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
