"""Reachability within a number of hops."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.plans.graph import PropertyGraph
from graphloom.plans.names import NODE
from graphloom.session import materialise


#: A level's vertices are broadcast to the edges if there are at most so many.
BROADCAST_IDS = 200_000


def ways(edges: DataFrame) -> DataFrame:
    """(src, dst): u to v, and v to u where an edge is not directed."""
    forward = F.struct(F.col("u").alias("src"), F.col("v").alias("dst"))
    back = F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))
    both = F.when(F.coalesce(F.col("directed"), F.lit(False)), F.array(forward)).otherwise(F.array(forward, back))
    return edges.select(F.explode(both).alias("w")).select("w.*")


def _level(vertices: DataFrame, value: int) -> tuple[DataFrame, int]:
    """(id, value) of one level as written, and how many there are."""
    seen = Observation()
    level = materialise(vertices.select("id", F.lit(value).cast("long").alias("value")).observe(seen, F.count("*").alias("n")), f"hops-{value}")
    return level, seen.get["n"]


def hop_distances(edges: DataFrame, hops: int, seeds: Sequence[str], missing: str = "error") -> DataFrame:
    """(id, value): least number of hops from any seed, for vertices within ``hops``.

    A seed from which no edge leads is an error unless ``missing`` is ``ignore``. Each level joins the frontier with the
    edges as they are, makes the reached ids distinct and drops what was reached before; levels are written to the shared
    folder. A frontier of at most ``BROADCAST_IDS`` ids is broadcast, so the edges are not shuffled; a larger one is joined
    by shuffling both, where adaptive execution splits hubs.
    """
    spark = edges.sparkSession
    wanted = list(dict.fromkeys(map(str, seeds)))
    paths, asked = ways(edges), spark.createDataFrame([(s,) for s in wanted], "id string")
    frontier, n = _level(paths.join(F.broadcast(asked), F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct(), 0)
    if n < len(wanted) and missing != "ignore":
        absent = [r["id"] for r in asked.join(frontier, "id", "left_anti").orderBy("id").limit(100).collect()]
        raise ValueError(f"invalid or missing seeds: {absent}")
    visited = frontier
    for level in range(1, hops + 1):
        if not n:
            break
        side = frontier.select(F.col("id").alias("src"))
        reached = paths.join(F.broadcast(side) if n <= BROADCAST_IDS else side, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier, n = _level(reached.join(visited.select("id"), "id", "left_anti"), level)
        visited = visited.unionAll(frontier)
    return visited


def nhops(graph: PropertyGraph, output: Any, hops: int, seeds: Sequence[str], where: Any = None, missing: str = "error") -> PropertyGraph:
    """New long node series: hops from the nearest seed over the edges under a clause; null beyond ``hops``."""
    name = graph.resolve_new(output, NODE)
    return graph.with_node_values(hop_distances(graph.edges_where(where), hops, seeds, missing), name, "long")
