"""Access to single records and cells, and columns set from keyed values.

A table has no places that could be written to: setting or clearing cells makes a graph with another
column, and deleting records one with fewer rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.mutate import TYPES
from graphloom.plans.graph import HIT, PropertyGraph, endpoints
from graphloom.plans.names import EDGE, NODE
from graphloom.session import materialise
from graphloom.sources.ingest import align


def series_values(graph: PropertyGraph, series: Any, where: Any = None) -> DataFrame:
    """(value): the values of a series that are set, one row per record under a clause."""
    name = graph.resolve(series)
    column = F.col(f"`{name.name}`")
    return graph.table_where(name.prefix, where).where(column.isNotNull()).select(column.alias("value"))


def get_records(graph: PropertyGraph, ids: Sequence[str] | DataFrame, series: Sequence[Any] | None = None) -> DataFrame:
    """Nodes by id, from a list or a DataFrame with a column ``id``; unknown ids have no row."""
    wanted = ids.select("id").distinct() if isinstance(ids, DataFrame) else graph.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    names = [graph.resolve(s, NODE) for s in (series if series is not None else graph.nodes.columns)]
    return graph.nodes.join(wanted, "id", "left_semi").select(*[F.col(f"`{n.name}`").alias(str(n)) for n in names])


def get(graph: PropertyGraph, node: str, series: Any) -> Any:
    """A node's value; None if it is not set; KeyError for an unknown node."""
    name = graph.resolve(series, NODE)
    rows = get_records(graph, [node], [name]).take(1)
    if not rows:
        raise KeyError(node)
    return rows[0][0]


def get_edges(graph: PropertyGraph, ends: Sequence[tuple[str, str]] | DataFrame, series: Sequence[Any] | None = None) -> DataFrame:
    """Edges from u to v, as stored, for pairs from a list or a DataFrame with columns ``u`` and ``v``; parallel edges each have a row."""
    if not isinstance(ends, DataFrame):
        ends = graph.spark.createDataFrame(list(dict.fromkeys(ends)), "u string, v string")
    names = [graph.resolve(s, EDGE) for s in (series if series is not None else graph.edges.columns)]
    return graph.edges.join(ends.select("u", "v").distinct(), ["u", "v"], "left_semi").select(*[F.col(f"`{n.name}`").alias(str(n)) for n in names])


def get_edge(graph: PropertyGraph, u: str, v: str, series: Any) -> list[Any]:
    """The values of the edges from u to v, None where one is not set; KeyError if there is no such edge."""
    rows = get_edges(graph, [(u, v)], [graph.resolve(series, EDGE)]).collect()
    if not rows:
        raise KeyError((u, v))
    return [r[0] for r in rows]


def add_node(graph: PropertyGraph, node: str, **values: Any) -> PropertyGraph:
    """The graph with one more node; values by series name. ValueError if it exists or a series does not."""
    if not graph.nodes.where(F.col("id") == node).isEmpty():
        raise ValueError(f"node exists: {node}")
    row = _row(graph, NODE, {"id": node} | values)
    return graph.replace(nodes=align([graph.nodes, row]), growth=(graph, {"nodes": row}))


def add_edge(graph: PropertyGraph, u: str, v: str, directed: bool = True, **values: Any) -> PropertyGraph:
    """The graph with one more edge, and its ends as nodes if they are none yet; values by series name."""
    row = _row(graph, EDGE, {"u": u, "v": v, "directed": directed} | values)
    ends = materialise(endpoints(row).join(graph.nodes.select("id"), "id", "left_anti"), "ends")
    return graph.replace(nodes=align([graph.nodes, ends]), edges=align([graph.edges, row]), growth=(graph, {"nodes": ends, "edges": row}))


def _row(graph: PropertyGraph, prefix: str, values: Mapping[str, Any]) -> DataFrame:
    """One row for a table, with its types; absent series are null."""
    schema = graph.table(prefix).schema
    for name in values:
        graph.resolve(f"{prefix}.{name}", prefix)
    made = [float(v) if v is not None and f.dataType.typeName() == "double" else v for f in schema.fields for v in [values.get(f.name)]]
    return graph.spark.createDataFrame([tuple(made)], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


def is_none(graph: PropertyGraph, node: str, series: Any) -> bool:
    """Whether a node's value is not set."""
    return get(graph, node, series) is None


def is_series_type(graph: PropertyGraph, series: Any, kind: Any) -> bool:
    """Whether a series has a type: bool, int64, double or string."""
    name = graph.resolve(series)
    return graph.table(name.prefix).schema[name.name].dataType.simpleString() == {"long": "bigint"}.get(TYPES[kind], TYPES[kind])


def load_factors(graph: PropertyGraph, prefix: str) -> DataFrame:
    """(series, records, filled, load_factor) of all series of the node or edge table; load factor of no records is 0."""
    table = graph.table(prefix)
    counted = table.agg(F.count("*").alias("records"), *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(table.columns)])
    pairs = F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("series"), F.col(f"n{k}").alias("filled")) for k, c in enumerate(table.columns)])
    factor = F.coalesce(F.try_divide(F.col("p.filled").cast("double"), F.col("records")), F.lit(0.0))
    return counted.select("records", F.explode(pairs).alias("p")).select("p.series", "records", "p.filled", factor.alias("load_factor"))


def set_values(graph: PropertyGraph, series: Any, values: Mapping[Any, Any] | DataFrame, kind: Any = None) -> PropertyGraph:
    """A series with new values for some records; made if it does not exist.

    Node series take a mapping by id or (id, value); edge series a mapping by (u, v) or (u, v, value), for all edges from u
    to v, as stored. Keys without a record are counted in the warnings; several values of one key are an error. Other
    records keep what they have.
    """
    name = graph.resolve(series) if graph.has_series(series) else graph.resolve_new(series)
    if name.reserved:
        raise ValueError(f"reserved series: {name}")
    keys, table = (("id",), graph.nodes) if name.prefix == NODE else (("u", "v"), graph.edges)
    if not isinstance(values, DataFrame):
        found = {type(v) for v in values.values() if v is not None}
        kind = kind or (found.pop() if len(found) == 1 else str)
        rows = [(*(k if name.prefix == EDGE else (k,)), v) for k, v in values.items()]
        values = graph.spark.createDataFrame(rows, f"{', '.join(f'{k} string' for k in keys)}, value {TYPES[kind]}")
    side = values.select(*[F.col(k).cast("string").alias(f"__{k}") for k in keys], F.col("value").alias("__value"))
    own = [f"__{k}" for k in keys]
    if not side.groupBy(*own).count().where("count > 1").isEmpty():
        raise ValueError("several values for one key")
    unknown = side.join(table.select(*[F.col(k).alias(f"__{k}") for k in keys]), own, "left_anti").count()
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in keys])
    joined = table.join(side.withColumn("__given", F.lit(True)), same, "left")
    old = F.col(f"`{name.name}`") if name.name in table.columns else F.lit(None)
    others = [F.col(f"`{c}`") for c in table.columns if c != name.name]
    made = graph.with_table(name.prefix, joined.select(*others, F.when(F.col("__given"), F.col("__value")).otherwise(old).alias(name.name)))
    if unknown:
        made.warnings[f"invalid {name.prefix}s"] += unknown
    return made


def unset(graph: PropertyGraph, series: Any, where: Any = None) -> PropertyGraph:
    """A series that is null under a clause, everywhere without one, and as it was elsewhere."""
    name = graph.resolve(series)
    if name.reserved:
        raise ValueError(f"reserved series: {name}")
    marked = graph.mark(name.prefix, where)
    return graph.with_table(name.prefix, marked.withColumn(name.name, F.when(~F.col(HIT), F.col(f"`{name.name}`"))).drop(HIT))


def remove_nodes(graph: PropertyGraph, where: Any = None) -> PropertyGraph:
    """Without the nodes under a clause and the edges that touch them, so that the graph stays sound."""
    marked = graph.mark_nodes(where)
    gone = marked.where(F.col(HIT)).select(F.col("id").alias("__end"))
    edges = graph.edges
    for end in ("u", "v"):
        edges = edges.join(gone, F.col(end) == F.col("__end"), "left_anti")
    return graph.replace(nodes=marked.where(~F.col(HIT)).drop(HIT), edges=edges)


def clear(graph: PropertyGraph) -> PropertyGraph:
    """The graph's series without any records."""
    return graph.replace(nodes=graph.nodes.limit(0), edges=graph.edges.limit(0))


def max_record(graph: PropertyGraph, prefix: str) -> int:
    """How many records a table has; records are not numbered, so this stands for the greatest index plus one."""
    return graph.table(prefix).count()
