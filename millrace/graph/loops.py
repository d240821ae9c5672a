"""Iterative graph algorithms as joins and aggregates over written tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.graph.frame import Graph
from millrace.iterate import bulk_iterate, delta_iterate, until_unchanged
from millrace.scratch import bucketed, drop, written, written_and_measured

UNREACHED = 1.7976931348623157e308


def pregel(graph: Graph, message: Column, combine: Column, apply: Column, active: Column, max_rounds: int | None = None) -> DataFrame:
    """Vertex-centric iteration.

    ``message`` is computed per edge from ``src_value``, ``src``, ``dst`` and ``edge_value``; ``combine``
    is an aggregate over ``message`` (added up in every task before the shuffle); ``apply`` gives the
    new value from ``value`` and ``message``, and ``active`` says whether the vertex changed. Only
    changed vertices send in the next round. Joins are merge joins: no round broadcasts through the driver.
    """
    edges = bucketed(graph.edges.select("src", "dst", F.col("value").alias("edge_value")), "src", "edges")

    def improve(work: DataFrame, solution: DataFrame, turn: int) -> DataFrame:
        senders = work.select(F.col("id").alias("src"), F.col("value").alias("src_value")).hint("merge")
        sent = senders.join(edges, "src").select(F.col("dst").alias("id"), message.alias("message"))
        received = sent.groupBy("id").agg(combine.alias("message"))
        met = solution.join(received.hint("merge"), "id").where(active)
        return met.select("id", apply.alias("value"))

    out = delta_iterate(graph.vertices, graph.vertices, "id", improve, max_rounds)[0]
    drop(edges)
    return out


def scatter_gather(graph: Graph, message: Column, combine: Column, update: Column, max_rounds: int) -> DataFrame:
    """Every vertex sends in every round; vertices without messages keep their value."""
    edges = bucketed(graph.edges.select("src", "dst", F.col("value").alias("edge_value")), "src", "edges")

    def step(state: DataFrame, turn: int) -> DataFrame:
        senders = state.select(F.col("id").alias("src"), F.col("value").alias("src_value"))
        received = (
            edges.join(senders, "src").select(F.col("dst").alias("id"), message.alias("message"))
            .groupBy("id").agg(combine.alias("message"))
        )
        value = F.when(F.col("message").isNotNull(), update).otherwise(F.col("value"))
        return state.join(received, "id", "left").select("id", value.alias("value"))

    out = bulk_iterate(graph.vertices, step, max_rounds)[0]
    drop(edges)
    return out


def gather_sum_apply(graph: Graph, gather: Column, combine: Column, apply: Column, max_rounds: int | None = None) -> DataFrame:
    """Vertices gather from all their in-neighbours: ``gather`` is over ``src_value`` and ``edge_value``, ``combine`` an
    aggregate over ``gathered``, ``apply`` the new value from ``value`` and ``gathered``.

    In a round only vertices with a neighbour that changed in the last one gather; it ends when none changes.
    """
    edges = bucketed(graph.edges.select("src", "dst", F.col("value").alias("edge_value")), "src", "edges")

    def improve(work: DataFrame, solution: DataFrame, turn: int) -> DataFrame:
        called = edges.join(work.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").select("dst").distinct()
        near = edges.join(called.hint("merge"), "dst", "left_semi").join(
            solution.select(F.col("id").alias("src"), F.col("value").alias("src_value")).hint("merge"), "src"
        )
        summed = near.select(F.col("dst").alias("id"), gather.alias("gathered")).groupBy("id").agg(combine.alias("gathered"))
        applied = solution.join(summed.hint("merge"), "id").select("id", "value", apply.alias("_new"))
        return applied.where(~F.col("_new").eqNullSafe(F.col("value"))).select("id", F.col("_new").alias("value"))

    out = delta_iterate(graph.vertices, graph.vertices, "id", improve, max_rounds)[0]
    drop(edges)
    return out


def shortest_paths(graph: Graph, source: Column, max_rounds: int | None = None) -> DataFrame:
    """Single-source shortest paths over double edge values; unreached vertices get the greatest double."""
    start = F.when(F.col("id") == source, F.lit(0.0)).otherwise(F.lit(UNREACHED))
    begun = Graph(graph.vertices.select("id", start.alias("value")), graph.edges)
    return pregel(
        begun,
        message=F.when(F.col("src_value") < UNREACHED, F.col("src_value") + F.col("edge_value")),
        combine=F.min("message"),
        apply=F.col("message"),
        active=F.col("message") < F.col("value"),
        max_rounds=max_rounds,
    )


def propagate_minimum(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """Smallest value reachable against the edges, by changed-only rounds; rounds grow with the diameter."""
    return pregel(
        graph, F.col("src_value"), F.min("message"), F.col("message"), F.col("message") < F.col("value"), max_rounds
    )


def connected_components(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, component): the smallest id of each component.

    Alternating large-star and small-star steps: every vertex links its neighbours to its smallest
    neighbour until only stars are left. Rounds grow with the logarithm of the size, not with the
    diameter, and a hub is reduced by a map-side minimum.
    """
    pairs = graph.edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )

    def step(links: DataFrame, turn: int) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()

    stars, _ = until_unchanged(pairs.distinct(), step, max_rounds, "stars")
    roots = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return graph.vertices.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def label_propagation(graph: Graph, max_rounds: int) -> DataFrame:
    """Each round a vertex takes the most frequent label sent to it; the greater label wins a tie."""
    edges = bucketed(graph.edges.select("src", "dst"), "src", "edges")

    def step(state: DataFrame, turn: int) -> DataFrame:
        sent = edges.join(state.select(F.col("id").alias("src"), F.col("value").alias("label")), "src")
        votes = sent.groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        won = votes.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct("n", "label")).alias("w"))
        return state.join(won, "id", "left").select("id", F.coalesce("w.label", "value").alias("value"))

    out = bulk_iterate(graph.vertices, step, max_rounds)[0]
    drop(edges)
    return out


def community_detection(graph: Graph, max_rounds: int, delta: float) -> DataFrame:
    """Label propagation with scores: labels lose ``delta / round`` of score when they move on.

    A vertex takes the label with the greatest score sum (the smaller label on a tie); its new score is
    the best single score received for that label.
    """
    edges = bucketed(graph.edges.select("src", "dst", F.col("value").alias("weight")), "src", "edges")
    start = graph.vertices.select("id", F.col("value").alias("label"), F.lit(1.0).alias("score"))

    def step(state: DataFrame, turn: int) -> DataFrame:
        senders = state.select(F.col("id").alias("src"), F.col("label").alias("sent"), F.col("score").alias("strength"))
        got = edges.join(senders, "src").select(
            F.col("dst").alias("id"), "sent", (F.col("strength") * F.col("weight")).alias("points")
        )
        per_label = got.groupBy("id", "sent").agg(F.sum("points").alias("all"), F.max("points").alias("best"))
        won = per_label.groupBy("id").agg(
            F.max(F.struct(F.col("all"), (-F.col("sent")).alias("first"), F.col("sent"), F.col("best"))).alias("w")
        )
        moved = F.when(F.col("w.sent") != F.col("label"), delta / turn).otherwise(0.0)
        joined = state.join(won, "id", "left")
        return joined.select(
            "id",
            F.coalesce("w.sent", "label").alias("label"),
            F.coalesce(F.col("w.best") - moved, F.col("score")).alias("score"),
        )

    out = bulk_iterate(start, step, max_rounds)[0].select("id", "label")
    drop(edges)
    return out


def page_rank(graph: Graph, damping: float = 0.85, max_rounds: int = 20, threshold: float | None = None) -> DataFrame:
    """(id, rank); the rank of vertices without out-edges is spread over all vertices.

    Stops early when the summed change of a round is at most ``threshold``.
    """
    pairs = graph.edges.select("src", "dst")
    fan = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    edges = bucketed(pairs.join(fan, "src"), "src", "edges")
    size = graph.vertices.count()
    sinks = graph.vertices.join(fan.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(True).alias("sink"))
    start = graph.vertices.join(sinks, "id", "left").select(
        "id", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / size).alias("rank"), F.lit(1.0).alias("change")
    )

    def step(state: DataFrame, turn: int) -> DataFrame:
        lost = state.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        share = state.select(F.col("id").alias("src"), "rank").join(edges, "src")
        got = share.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("fan")).alias("in"))
        rank = (1 - damping) / size + damping * (F.coalesce(F.col("in"), F.lit(0.0)) + lost / size)
        joined = state.join(got, "id", "left").select("id", "sink", rank.alias("rank"), F.col("rank").alias("old"))
        return joined.select("id", "sink", "rank", F.abs(F.col("rank") - F.col("old")).alias("change"))

    stop = None if threshold is None else (lambda seen, before: seen["change"] <= threshold)
    out = bulk_iterate(start, step, max_rounds, {"change": F.sum("change")}, stop)[0].select("id", "rank")
    drop(edges)
    return out


def hits(graph: Graph, max_rounds: int = 10) -> DataFrame:
    """(id, hub, authority), both scaled to length 1 in every round."""
    edges = written(graph.edges.select("src", "dst"), "edges")
    by = {end: bucketed(edges, end, f"edges-{end}") for end in ("src", "dst")}

    def spread(scores: DataFrame, value: str, start: str, end: str, name: str) -> DataFrame:
        sent = by[start].join(scores.select(F.col("id").alias(start), value), start)
        return sent.groupBy(F.col(end).alias("id")).agg(F.sum(value).alias(name))

    def unit(scores: DataFrame, name: str) -> DataFrame:
        length = scores.agg(F.sqrt(F.sum(F.col(name) * F.col(name)))).scalar()
        return scores.withColumn(name, F.col(name) / length)

    def step(state: DataFrame, turn: int) -> DataFrame:
        authority = written(spread(state, "hub", "src", "dst", "authority"), "authority")
        authority = unit(authority, "authority")
        hub = unit(spread(authority, "authority", "dst", "src", "hub"), "hub")
        joined = state.select("id").join(hub, "id", "left").join(authority, "id", "left")
        return joined.fillna(0.0, ["hub", "authority"]).select("id", "hub", "authority")

    begin = 1.0 / math.sqrt(max(1, graph.vertices.count()))
    start = graph.vertices.select("id", F.lit(begin).alias("hub"), F.lit(begin).alias("authority"))
    out = bulk_iterate(start, step, max_rounds)[0]
    for table in (edges, *by.values()):
        drop(table)
    return out


def transitive_closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All (src, dst) with a path. New paths only are extended, so each is joined once.

    Raises if there are still new paths after ``max_rounds``.
    """
    base = written(edges.select("src", "dst").distinct(), "closure")
    hop = bucketed(base.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst", "hops")
    known, fresh = base, base
    for turn in itertools.count(1):
        longer = fresh.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        fresh, seen = written_and_measured(longer.join(known, ["src", "dst"], "left_anti"), "paths")
        if seen["rows"] == 0:
            return known
        if max_rounds is not None and turn >= max_rounds:
            raise RuntimeError(f"there are still new paths after {max_rounds} rounds")
        known = known.unionByName(fresh)
