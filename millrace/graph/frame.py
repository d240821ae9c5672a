"""Graphs as two frames: vertices (id, value) and edges (src, dst, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, value: Column | None = None) -> Graph:
        """Vertices are the distinct endpoints."""
        if "value" not in edges.columns:
            edges = edges.withColumn("value", F.lit(None).cast("double"))
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        initial = F.lit(None).cast("double") if value is None else value
        return Graph(ends.withColumn("value", initial), edges.select("src", "dst", "value"))

    def map_vertices(self, value: Column) -> Graph:
        return Graph(self.vertices.withColumn("value", value), self.edges)

    def map_edges(self, value: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumn("value", value))

    def translate_ids(self, to: Column) -> Graph:
        """``to`` is an expression over ``id``; it must keep ids distinct."""
        vertices = self.vertices.select(to.alias("id"), "value")
        source = self.edges.select(F.col("src").alias("id"), "dst", "value").select(to.alias("src"), "dst", "value")
        both = source.select("src", F.col("dst").alias("id"), "value").select("src", to.alias("dst"), "value")
        return Graph(vertices, both)

    def triplets(self) -> DataFrame:
        a = self.vertices.select(F.col("id").alias("src"), F.col("value").alias("src_value"))
        b = self.vertices.select(F.col("id").alias("dst"), F.col("value").alias("dst_value"))
        return self.edges.join(a, "src").join(b, "dst").select("src", "dst", "src_value", "dst_value", "value")

    def subgraph(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Keep the vertices and edges meeting the predicates, and edges whose both ends stay."""
        vertices = self.vertices if vertex is None else self.vertices.where(vertex)
        edges = self.edges if edge is None else self.edges.where(edge)
        if vertex is not None:
            ids = vertices.select("id")
            edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            edges = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(vertices, edges.select("src", "dst", "value"))

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))

    def undirected(self) -> Graph:
        """Every edge in both directions."""
        return Graph(self.vertices, self.edges.unionByName(self.reverse().edges))

    def union(self, other: Graph) -> Graph:
        vertices = self.vertices.unionByName(other.vertices).dropDuplicates(["id"])
        return Graph(vertices, self.edges.unionByName(other.edges))

    def difference(self, other: Graph) -> Graph:
        """Remove the other graph's vertices, with their edges."""
        gone = other.vertices.select("id")
        kept = self.vertices.join(gone, "id", "left_anti")
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
        edges = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(kept, edges.select("src", "dst", "value"))

    def intersect(self, other: Graph, distinct: bool = True) -> Graph:
        """Edges in both graphs (same ends and value) with their vertices."""
        edges = self.edges.intersect(other.edges) if distinct else self.edges.intersectAll(other.edges)
        return Graph(self.vertices.join(Graph.from_edges(edges).vertices.select("id"), "id", "left_semi"), edges)

    def add_edges(self, edges: DataFrame) -> Graph:
        """Only edges between known vertices are added."""
        ids = self.vertices.select("id")
        known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        known = known.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices, self.edges.unionByName(known.select("src", "dst", "value")))

    def remove_vertices(self, ids: DataFrame) -> Graph:
        return self.difference(Graph(ids.select("id").withColumn("value", F.lit(None)), self.edges.limit(0)))

    def remove_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "value"))

    def invalid_edges(self) -> DataFrame:
        """Edges whose endpoint is no vertex; empty for a valid graph."""
        ends = self.edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("id"))
        return ends.join(self.vertices.select("id"), "id", "left_anti").select("src", "dst").distinct()

    def simplify(self, undirected: bool = False, clip_and_flip: bool = False) -> Graph:
        """Drop self-loops and duplicate edges; ``undirected`` also mirrors every edge.

        ``clip_and_flip`` first drops the edges from a lower to a higher id, as for generated graphs.
        """
        pairs = self.edges.where("src <> dst").select("src", "dst")
        if undirected:
            if clip_and_flip:
                pairs = pairs.where("src > dst")
            low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
            once = pairs.select(low, high).distinct()
            pairs = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        else:
            pairs = pairs.distinct()
        return Graph(self.vertices, pairs.withColumn("value", F.lit(None).cast("double")))

    def degrees(self, include_zero: bool = True) -> DataFrame:
        """(id, out_degree, in_degree, degree); degree counts the distinct neighbours of a simple graph."""
        ends = self.edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                    F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
                )
            ).alias("e")
        ).select("e.*")
        counted = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        pairs = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        near = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        joined = counted.join(near, "id")
        if include_zero:
            names = ["out_degree", "in_degree", "degree"]
            joined = self.vertices.select("id").join(joined, "id", "left").fillna(0, names)
        return joined.select("id", "out_degree", "in_degree", "degree")

    def edge_degrees(self) -> DataFrame:
        """Edges with the degree of both ends."""
        near = self.degrees(include_zero=False).select("id", "degree")
        a = near.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
        b = near.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
        return self.edges.join(a, "src").join(b, "dst").select("src", "dst", "src_degree", "dst_degree")

    def maximum_degree(self, most: int) -> Graph:
        """Remove vertices with more than ``most`` neighbours."""
        over = self.degrees(include_zero=False).where(F.col("degree") > most)
        return self.remove_vertices(over)

    def reduce_neighbours(self, direction: str, **aggregates: Column) -> DataFrame:
        """Aggregate over neighbour values and edge values per vertex; direction is in, out or all.

        The expressions use ``neighbour`` (id), ``neighbour_value`` and ``edge_value``.
        """
        views = []
        if direction in ("out", "all"):
            views.append(self.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.col("value").alias("edge_value")))
        if direction in ("in", "all"):
            views.append(self.edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.col("value").alias("edge_value")))
        if not views:
            raise ValueError("direction is in, out or all")
        near = views[0] if len(views) == 1 else views[0].unionByName(views[1])
        values = self.vertices.select(F.col("id").alias("neighbour"), F.col("value").alias("neighbour_value"))
        return near.join(values, "neighbour").groupBy("id").agg(*[a.alias(n) for n, a in aggregates.items()])

    def join_vertices(self, other: DataFrame, value: Column) -> Graph:
        """``value`` may use ``value`` and the columns of ``other`` (keyed by id); unmatched stay as they are."""
        joined = self.vertices.join(other.withColumn("_hit", F.lit(True)), "id", "left")
        changed = F.when(F.col("_hit"), value).otherwise(F.col("value")).alias("value")
        return Graph(joined.select("id", changed), self.edges)

    def summarize(self) -> Graph:
        """Vertices grouped by value, edges by the groups of their ends and their value, with counts."""
        groups = self.vertices.groupBy("value").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        member = self.vertices.join(groups.select("value", F.col("id").alias("grp")), "value").select("id", "grp")
        a = member.select(F.col("id").alias("src"), F.col("grp").alias("a"))
        b = member.select(F.col("id").alias("dst"), F.col("grp").alias("b"))
        edges = self.edges.join(a, "src").join(b, "dst").groupBy("a", "b", "value").agg(F.count(F.lit(1)).alias("n"))
        return Graph(
            groups.select("id", F.struct("value", "n").alias("value")),
            edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.struct("value", "n").alias("value")),
        )
