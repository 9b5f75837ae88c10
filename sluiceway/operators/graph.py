"""Reachability over many graphs at once, by frontiers.

Each round joins the nodes that the last one found with the edges and keeps, by
an anti-join, those not met before; so a cycle ends where it closes.  A round is
written once, as a table; a small frontier is sent to the edges, a large one is
dealt with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.staging import written


def _closure(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node: the seeds and all that edges (graph, src, dst) lead to; keys hold graph, and go along.

    A node is in one frontier only, so each edge is followed once a key, and
    edges need not be made distinct first.  The node is the first key of joins:
    rows are sorted by the first bytes of the first key, and graphs are few.
    """
    steps = written(edges.select("graph", F.col("src").alias("node"), F.col("dst").alias("next")).dropna())
    front = written(seeds.select("node", *keys).dropna().distinct())
    met = [front]
    while not front.isEmpty():
        reached = front.join(steps, ["node", "graph"]).select(F.col("next").alias("node"), *keys).distinct()
        front = written(reached.join(reduce(DataFrame.unionByName, met), ["node", *keys], "left_anti"))
        met.append(front)
    return reduce(DataFrame.unionByName, met).select(*keys, "node")


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph, node: seeds (graph, node) and all nodes that edges (graph, src, dst) lead to from them.

    Graphs do not meet.  Repeated edges and seeds count once; edges and seeds
    with a null lead nowhere; a seed without edges is reached.
    """
    return _closure(edges, seeds, ["graph"])


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))


def dead_nodes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph, node: those of nodes that no seed leads to."""
    return nodes.select("node", "graph").distinct().join(reached(edges, seeds), ["node", "graph"], "left_anti").select("graph", "node")


def feeding_sources(edges: DataFrame, sinks: DataFrame, sources: DataFrame) -> DataFrame:
    """graph, sink, source: the sources (graph, node) from which edges lead to each sink (graph, node).

    The walk goes backwards and ends at a source; what feeds a source is not
    followed.  Each sink has its own walk, so the rows are at most sinks times
    nodes of a graph.
    """
    into = edges.join(sources.select("graph", F.col("node").alias("dst")).distinct(), ["graph", "dst"], "left_anti")
    seeds = sinks.select("graph", "node", F.col("node").alias("sink"))
    pairs = _closure(reversed_edges(into).distinct(), seeds, ["graph", "sink"])
    return pairs.join(sources.select("graph", "node").distinct(), ["graph", "node"]).select("graph", "sink", F.col("node").alias("source"))
