"""Degrees of nodes as new node series."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import HIT, PropertyGraph
from graphloom.plans.names import NODE


def degree_counts(edges: DataFrame) -> DataFrame:
    """(id, in, out) over the ends of edges; an undirected edge counts both ways at both ends."""
    both = ~F.coalesce(F.col("directed"), F.lit(False))
    u = F.struct(F.col("u").alias("id"), both.cast("long").alias("i"), F.lit(1).cast("long").alias("o"))
    v = F.struct(F.col("v").alias("id"), F.lit(1).cast("long").alias("i"), both.cast("long").alias("o"))
    ends = edges.select(F.explode(F.array(u, v)).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in"), F.sum("o").alias("out"))


def _with_degrees(graph: PropertyGraph, outputs: dict[str, Any], where: Any) -> PropertyGraph:
    names = {side: graph.resolve_new(name, NODE) for side, name in outputs.items() if name is not None}
    if len(set(names.values())) < len(names):
        raise ValueError("in and out degree need different names")
    counts = degree_counts(graph.edges_where(where)).toDF("__id", "__in", "__out")
    marked = graph.mark_nodes(where)
    joined = marked.join(counts, F.col("id") == F.col("__id"), "left")
    own = [F.col(f"`{c}`") for c in graph.nodes.columns]
    made = [F.when(F.col(HIT), F.coalesce(F.col(f"__{side}"), F.lit(0))).cast("long").alias(name.name) for side, name in names.items()]
    return graph.replace(nodes=joined.select(*own, *made))


def in_degree(graph: PropertyGraph, output: Any, where: Any = None) -> PropertyGraph:
    """New long node series: edges that lead to the node. 0 for selected nodes without edges, null for others."""
    return _with_degrees(graph, {"in": output}, where)


def out_degree(graph: PropertyGraph, output: Any, where: Any = None) -> PropertyGraph:
    """New long node series: edges that lead from the node."""
    return _with_degrees(graph, {"out": output}, where)


def degrees(graph: PropertyGraph, in_output: Any, out_output: Any, where: Any = None) -> PropertyGraph:
    """Both degrees in one pass over the edges."""
    return _with_degrees(graph, {"in": in_output, "out": out_output}, where)
