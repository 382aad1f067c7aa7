"""Selection, description, exact distinct counts, value counts, top-k and rows as JSON."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import PropertyGraph
from graphloom.plans.names import EDGE, NODE, SeriesName
from graphloom.session import materialise


def _columns(graph: PropertyGraph, prefix: str, series: Sequence[Any] | None) -> list[SeriesName]:
    if series is None:
        return [SeriesName(prefix, c) for c in graph.table(prefix).columns]
    return [graph.resolve(s, prefix) for s in series]


def _select(graph: PropertyGraph, prefix: str, series: Sequence[Any] | None, limit: int, where: Any) -> DataFrame:
    names = _columns(graph, prefix, series)
    table = graph.table_where(prefix, where)
    if not names:
        return table.select().limit(0)
    found = table.select(*[F.col(f"`{n.name}`").alias(str(n)) for n in names])
    return found.limit(limit) if limit else found


def select_edges(graph: PropertyGraph, series: Sequence[Any] | None = None, limit: int = 0, where: Any = None) -> DataFrame:
    """Named edge series (default all) of the edges under a clause; columns have qualified names; limit 0 is none."""
    return _select(graph, EDGE, series, limit, where)


def select_nodes(graph: PropertyGraph, series: Sequence[Any] | None = None, limit: int = 0, where: Any = None) -> DataFrame:
    """Named node series (default all) of the nodes under a clause; limit 0 is none."""
    return _select(graph, NODE, series, limit, where)


def num_edges(graph: PropertyGraph, where: Any = None) -> int:
    """How many edges are under a clause."""
    return graph.edges_where(where).count()


def num_nodes(graph: PropertyGraph, where: Any = None) -> int:
    """How many nodes are under a clause."""
    return graph.nodes_where(where).count()


def describe_frame(graph: PropertyGraph, where: Any = None) -> DataFrame:
    """(nv, ne): counts of nodes and edges under a clause, in one row."""
    rows = graph.nodes_where(where).select(F.lit(1).alias("n"), F.lit(0).alias("e"))
    rows = rows.unionAll(graph.edges_where(where).select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nv"), F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("ne"))


def describe(graph: PropertyGraph, where: Any = None) -> dict[str, Any]:
    """{nv, ne, path} under a clause."""
    row = describe_frame(graph, where).first()
    return {"nv": row["nv"], "ne": row["ne"], "path": graph.path}


def nunique_frame(graph: PropertyGraph, series: Sequence[Any] | None = None, where: Any = None, approximate: bool = False) -> DataFrame:
    """(series, n): exact number of different values of each series under a clause, nulls apart.

    Each series is grouped by its values, which reads its column alone and combines before it shuffles; a clause is
    evaluated once, its rows are written. ``approximate`` uses sketches instead, without shuffles of values.
    """
    names = [graph.resolve(s) for s in series] if series is not None else [SeriesName(p, c) for p in (EDGE, NODE) for c in graph.table(p).columns]
    parts = []
    for prefix in (EDGE, NODE):
        own = list(dict.fromkeys(n for n in names if n.prefix == prefix))
        if not own:
            continue
        table = graph.table_where(prefix, where).select(*[F.col(f"`{n.name}`") for n in own])
        if approximate:
            counted = table.agg(*[F.approx_count_distinct(F.col(f"`{n.name}`")).alias(f"n{k}") for k, n in enumerate(own)])
            pairs = F.array(*[F.struct(F.lit(str(n)).alias("series"), F.col(f"n{k}").alias("n")) for k, n in enumerate(own)])
            parts.append(counted.select(F.explode(pairs).alias("p")).select("p.*"))
            continue
        if where is not None and len(own) > 1:
            table = materialise(table, "nunique")
        for n in own:
            values = table.select(F.col(f"`{n.name}`").alias("value")).distinct()
            parts.append(values.agg(F.count("value").alias("n")).select(F.lit(str(n)).alias("series"), "n"))
    if not parts:
        return graph.spark.createDataFrame([], "series string, n long")
    return reduce(DataFrame.unionAll, parts)


def nunique(graph: PropertyGraph, series: Sequence[Any] | None = None, where: Any = None) -> dict[str, int]:
    """{series: number of different values}; all series by default."""
    return {r["series"]: r["n"] for r in nunique_frame(graph, series, where).collect()}


def value_counts(graph: PropertyGraph, series: Any, k: int | None = None, where: Any = None) -> DataFrame:
    """(value, count) of a series under a clause, null a value like any other.

    k > 0 keeps the k most frequent, k < 0 the least frequent; equal counts are ordered by value.
    """
    name = graph.resolve(series)
    counted = graph.table_where(name.prefix, where).groupBy(F.col(f"`{name.name}`").alias("value")).count()
    if k is None:
        return counted
    by = F.desc("count") if k > 0 else F.asc("count")
    return counted.orderBy(by, F.asc_nulls_last("value")).limit(abs(k))


def topk(graph: PropertyGraph, series: Any, k: int = 10, extra: Sequence[Any] = (), where: Any = None, order: str | Column = "desc") -> DataFrame:
    """The k rows with the greatest (order ``asc``: least) values of a series, nulls last, with extra series of the same table.

    order may be a sorting Column instead. Ties go by the extra series, then by the key columns of the table.
    """
    name = graph.resolve(series)
    names = [name, *(graph.resolve(s, name.prefix) for s in extra)]
    table = graph.table_where(name.prefix, where)
    key = F.col(f"`{name.name}`")
    first = order if isinstance(order, Column) else key.desc_nulls_last() if order == "desc" else key.asc_nulls_last()
    ties = [F.asc_nulls_last(F.col(f"`{n.name}`")) for n in names[1:]] + [F.asc_nulls_last(c) for c in (("id",) if name.prefix == NODE else ("u", "v"))]
    return table.orderBy(first, *ties).limit(k).select(*[F.col(f"`{n.name}`").alias(str(n)) for n in names])


def rows_json(rows: DataFrame) -> DataFrame:
    """(json): each row as an object, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("json"))


def rows_arrays(rows: DataFrame) -> list[list[Any]]:
    """A few rows as lists in column order, nulls kept; for top-k results."""
    return [list(r) for r in rows.collect()]
