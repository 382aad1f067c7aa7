"""Assignment, synthetic series, schema changes and deletion; each returns a new graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.generators import generator
from graphloom.plans.graph import HIT, PropertyGraph
from graphloom.plans.names import EDGE, SeriesName

TYPES = {"bool": "boolean", "boolean": "boolean", "int": "long", "int64": "long", "long": "long", "double": "double", "string": "string", bool: "boolean", int: "long", float: "double", str: "string"}
#: A list of deleted values beyond this is joined instead of written into the plan.
INLINE_VALUES = 10_000


def _spark_type(value: Any) -> str:
    for kind in (bool, int, float, str):  # bool is an int
        if isinstance(value, kind):
            return TYPES[kind]
    raise ValueError(f"a series holds booleans, integers, doubles or strings, not {value!r}")


def _with_column(graph: PropertyGraph, name: SeriesName, column: Column, where: Any) -> PropertyGraph:
    marked = graph.mark(name.prefix, where)
    return graph.with_table(name.prefix, marked.withColumn(name.name, F.when(F.col(HIT), column)).drop(HIT))


def assign(graph: PropertyGraph, series: Any, value: Any, where: Any = None) -> PropertyGraph:
    """New series with a constant where a clause holds and null elsewhere."""
    name = graph.resolve_new(series)
    return _with_column(graph, name, F.lit(value).cast(_spark_type(value)), where)


def add_series(graph: PropertyGraph, series: Any, kind: Any = "string") -> PropertyGraph:
    """New series of nulls of a type: bool, int64, double or string."""
    name = graph.resolve_new(series)
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return graph.with_table(name.prefix, graph.table(name.prefix).withColumn(name.name, F.lit(None).cast(TYPES[kind])))


def add_generated(graph: PropertyGraph, series: Any, made: str | Column | Callable[[pd.Series], Any], where: Any = None, seed: int | None = None, kind: str = "string") -> PropertyGraph:
    """New series from a generator where a clause holds, null elsewhere.

    made: the name of a generator, a Column, or a function that gets a pandas Series of row numbers
    (of no meaning but their count) and returns as many values of type ``kind``.
    """
    name = graph.resolve_new(series)
    if isinstance(made, str):
        column = generator(made, seed)
    elif isinstance(made, Column):
        column = made
    else:
        column = F.pandas_udf(lambda rows, f=made: pd.Series(list(f(rows))), TYPES[kind]).asNondeterministic()(F.monotonically_increasing_id())
    return _with_column(graph, name, column, where)


def drop_series(graph: PropertyGraph, series: Any) -> PropertyGraph:
    """Without a series; reserved and unknown ones are errors."""
    name = graph.resolve(series)
    if name.reserved:
        raise ValueError(f"reserved series: {name}")
    made = graph.with_table(name.prefix, graph.table(name.prefix).drop(name.name))
    return made.replace(relabelled=(graph, name.prefix, {name.name: None}))


def rename_series(graph: PropertyGraph, old: Any, new: Any) -> PropertyGraph:
    """With a series under another name of the same prefix, which an unqualified new name takes from the old."""
    name = graph.resolve(old)
    other = SeriesName.parse(new, name.prefix)
    if name.reserved or other.reserved:
        raise ValueError(f"reserved series: {name if name.reserved else other}")
    if other.prefix != name.prefix:
        raise ValueError(f"a series keeps its prefix: {name} to {other}")
    if graph.has_series(other):
        raise ValueError(f"series exists: {other}")
    made = graph.with_table(name.prefix, graph.table(name.prefix).withColumnRenamed(name.name, other.name))
    return made.replace(relabelled=(graph, name.prefix, {name.name: other.name}))


def erase_edges(graph: PropertyGraph, where: Any = None, series: Any = None, values: Sequence[str] | None = None) -> PropertyGraph:
    """Without the edges under a clause (all without one), or those whose string series has one of ``values``; nodes stay."""
    if series is None and values is None:
        return graph.replace(edges=graph.mark_edges(where).where(~F.col(HIT)).drop(HIT))
    if series is None or values is None or where is not None:
        raise ValueError("give either a clause or a series with a list of values")
    name = graph.resolve(series, EDGE)
    column = F.col(f"`{name.name}`")
    if not isinstance(graph.edges.schema[name.name].dataType, T.StringType):
        raise ValueError(f"not a series of strings: {name}")
    if len(values) <= INLINE_VALUES:
        return graph.replace(edges=graph.edges.where(column.isNull() | ~column.isin(list(values))))
    listed = graph.spark.createDataFrame([(v,) for v in set(values)], "__value string")
    return graph.replace(edges=graph.edges.join(listed, column == F.col("__value"), "left_anti"))
