"""The property graph: two DataFrames and the meaning of where-clauses over them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from functools import partial
from importlib import import_module
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.names import EDGE, NODE, Selector, SeriesName
from graphloom.plans.where import ALL, WhereClause

HIT = "__hit"
#: Operations that a graph offers as methods, by module; each takes the graph first.
METHODS = {
    "graphloom.operators.query": "select_edges select_nodes num_edges num_nodes describe describe_frame nunique nunique_frame value_counts topk",
    "graphloom.operators.degree": "in_degree out_degree degrees",
    "graphloom.operators.traverse": "nhops",
    "graphloom.operators.components": "components",
    "graphloom.operators.sample": "sample_edges sample_nodes select_sample_edges select_sample_nodes",
    "graphloom.operators.mutate": "assign add_series add_generated drop_series rename_series erase_edges",
    "graphloom.operators.records": "get get_records get_edge get_edges is_none load_factors series_values add_node add_edge set_values unset remove_nodes",
    "graphloom.sources.ingest": "ingest_frames ingest_parquet_edges ingest_csv_edges",
    "graphloom.sources.sinks": "dump_edges dump_nodes",
}
_MODULE_OF = {name: module for module, names in METHODS.items() for name in names.split()}
NODE_SCHEMA = T.StructType([T.StructField("id", T.StringType())])
EDGE_SCHEMA = T.StructType([T.StructField("u", T.StringType()), T.StructField("v", T.StringType()), T.StructField("directed", T.BooleanType())])


@dataclass
class PropertyGraph:
    """A property multigraph. Operations return DataFrames, values or a new graph; none changes this one.

    nodes has a unique column ``id``; edges has ``u``, ``v`` and ``directed``. All other columns are
    nullable series. ``warnings`` counts what was skipped on the way here. ``growth`` is the graph that
    this one grew from by added rows alone, and these rows by table; a store then writes no others.
    ``relabelled`` is the graph that this one differs from by names of series alone, the prefix, and the
    names (None for a dropped one); a store then writes no rows.
    """

    nodes: DataFrame
    edges: DataFrame
    warnings: Counter = field(default_factory=Counter)
    path: str | None = None
    strict_reference: bool = False
    growth: tuple[PropertyGraph, dict[str, DataFrame]] | None = field(default=None, repr=False)
    relabelled: tuple[PropertyGraph, str, dict[str, str | None]] | None = field(default=None, repr=False)

    @classmethod
    def empty(cls, spark: SparkSession, **more: Any) -> PropertyGraph:
        """A graph without rows, with the four reserved series."""
        return cls(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), **more)

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, **more: Any) -> PropertyGraph:
        """From an edge table with u, v and directed; nodes default to the edges' ends."""
        return cls(endpoints(edges) if nodes is None else nodes, edges, **more)

    def __getattr__(self, name: str) -> Any:
        """Operations as methods: ``graph.nunique(...)`` is ``query.nunique(graph, ...)``."""
        if name in _MODULE_OF:
            return partial(getattr(import_module(_MODULE_OF[name]), name), self)
        raise AttributeError(name)

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *_MODULE_OF]

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def node(self) -> Selector:
        return Selector(NODE)

    @property
    def edge(self) -> Selector:
        return Selector(EDGE)

    def replace(self, **changes: Any) -> PropertyGraph:
        """This graph with other nodes, edges or settings."""
        return replace(self, **({"warnings": Counter(self.warnings), "growth": None, "relabelled": None} | changes))

    def table(self, prefix: str) -> DataFrame:
        return self.nodes if prefix == NODE else self.edges

    # catalogue

    def node_series(self) -> list[str]:
        """Qualified names of the node series."""
        return [f"{NODE}.{c}" for c in self.nodes.columns]

    def edge_series(self) -> list[str]:
        """Qualified names of the edge series."""
        return [f"{EDGE}.{c}" for c in self.edges.columns]

    def has_series(self, name: Any) -> bool:
        """Whether a series exists; ill-formed names do not."""
        try:
            parsed = SeriesName.parse(name)
        except ValueError:
            return False
        return parsed.name in self.table(parsed.prefix).columns

    def resolve(self, name: Any, prefix: str | None = None, default: str | None = None) -> SeriesName:
        """The name of an existing series, of the given prefix if any; ValueError otherwise."""
        parsed = SeriesName.parse(name, default or prefix)
        if prefix and parsed.prefix != prefix:
            raise ValueError(f"not a series of {prefix}s: {parsed}")
        if parsed.name not in self.table(parsed.prefix).columns:
            raise ValueError(f"no such series: {parsed}")
        return parsed

    def resolve_new(self, name: Any, prefix: str | None = None, default: str | None = None) -> SeriesName:
        """The name of a series to be made; ValueError if it exists or has another prefix."""
        parsed = SeriesName.parse(name, default or prefix)
        if prefix and parsed.prefix != prefix:
            raise ValueError(f"not a series of {prefix}s: {parsed}")
        if parsed.reserved or parsed.name in self.table(parsed.prefix).columns:
            raise ValueError(f"series exists: {parsed}")
        return parsed

    def selector_info(self) -> dict[str, str]:
        """All selectors with their types, those of edges' ends included."""
        found = {f"{NODE}.{f.name}": f.dataType.simpleString() for f in self.nodes.schema.fields}
        found |= {f"{EDGE}.{f.name}": f.dataType.simpleString() for f in self.edges.schema.fields}
        for end in ("u", "v"):
            found |= {f"{EDGE}.{end}.{f.name}": f.dataType.simpleString() for f in self.nodes.schema.fields}
        return found

    # where-clauses

    def clause(self, where: Any) -> WhereClause:
        """Anything that describes a where-clause, as one."""
        return WhereClause.of(where, self.strict_reference)

    def _inherited(self, clause: WhereClause, edges: DataFrame) -> DataFrame:
        """Edges with the columns ``u.x`` and ``v.x`` that a clause reads from their ends."""
        for end in ("u", "v"):
            wanted = sorted({s.name for s in clause.series() if s.prefix == EDGE and s.name.startswith(f"{end}.") and s.name not in edges.columns and s.name[2:] in self.nodes.columns})
            if wanted:
                side = self.nodes.select(F.col("id").alias("__end"), *[F.col(f"`{w[2:]}`").alias(w) for w in wanted])
                edges = edges.join(side, F.col(end) == F.col("__end"), "left").drop("__end")
        return edges

    def _condition(self, clause: WhereClause, table: DataFrame) -> Column:
        condition = clause.condition(table.schema)
        if condition is None:
            self.warnings[f"where-clause reads a series that does not exist: {sorted(clause.names)}"] += 1
            return F.lit(False)
        return condition

    def _own_edges(self, clause: WhereClause) -> DataFrame:
        """Edges that an edge clause or constant clause selects."""
        wide = self._inherited(clause, self.edges)
        return wide.where(self._condition(clause, wide)).select(*_quoted(self.edges))

    def edges_where(self, where: Any = None) -> DataFrame:
        """Edges under a clause: an edge clause selects edges, a node clause those with both ends selected."""
        clause = self.clause(where)
        if clause.kind == ALL and clause.rule is True and clause.predicate is None:
            return self.edges
        if clause.kind != NODE:
            return self._own_edges(clause)
        held = self.nodes.where(self._condition(clause, self.nodes)).select(F.col("id").alias("__end"))
        inside = self.edges.join(held, F.col("u") == F.col("__end"), "left_semi")
        return inside.join(held, F.col("v") == F.col("__end"), "left_semi")

    def nodes_where(self, where: Any = None) -> DataFrame:
        """Nodes under a clause: a node clause selects nodes, an edge clause the ends of selected edges."""
        clause = self.clause(where)
        if clause.kind == ALL and clause.rule is True and clause.predicate is None:
            return self.nodes
        if clause.kind != EDGE:
            return self.nodes.where(self._condition(clause, self.nodes))
        return self.nodes.join(endpoints(self._own_edges(clause)), "id", "left_semi")

    def mark_edges(self, where: Any = None) -> DataFrame:
        """All edges with a boolean ``HIT``: whether ``edges_where`` would return them. Never null."""
        clause = self.clause(where)
        if clause.kind != NODE:
            wide = self._inherited(clause, self.edges)
            return wide.withColumn(HIT, self._condition(clause, wide)).select(*_quoted(self.edges), HIT)
        held = self.nodes.where(self._condition(clause, self.nodes)).select(F.col("id"))
        marked = self.edges
        for end in ("u", "v"):
            marked = marked.join(held.select(F.col("id").alias(f"__{end}")), F.col(end) == F.col(f"__{end}"), "left")
        return marked.withColumn(HIT, F.col("__u").isNotNull() & F.col("__v").isNotNull()).drop("__u", "__v")

    def mark_nodes(self, where: Any = None) -> DataFrame:
        """All nodes with a boolean ``HIT``: whether ``nodes_where`` would return them. Never null."""
        clause = self.clause(where)
        if clause.kind != EDGE:
            return self.nodes.withColumn(HIT, self._condition(clause, self.nodes))
        ends = endpoints(self._own_edges(clause)).select(F.col("id").alias("__end"))
        return self.nodes.join(ends, F.col("id") == F.col("__end"), "left").withColumn(HIT, F.col("__end").isNotNull()).drop("__end")

    def table_where(self, prefix: str, where: Any = None) -> DataFrame:
        return self.nodes_where(where) if prefix == NODE else self.edges_where(where)

    def mark(self, prefix: str, where: Any = None) -> DataFrame:
        return self.mark_nodes(where) if prefix == NODE else self.mark_edges(where)

    def subgraph(self, where: Any = None) -> PropertyGraph:
        """The nodes and edges that a clause selects."""
        return self.replace(nodes=self.nodes_where(where), edges=self.edges_where(where))

    def with_table(self, prefix: str, table: DataFrame) -> PropertyGraph:
        return self.replace(nodes=table) if prefix == NODE else self.replace(edges=table)

    def with_node_values(self, values: DataFrame, output: SeriesName, kind: str) -> PropertyGraph:
        """Nodes with a new series from (id, value); ids without a value get null."""
        side = values.select(F.col("id").alias("__id"), F.col("value").cast(kind).alias(output.name))
        return self.replace(nodes=self.nodes.join(side, F.col("id") == F.col("__id"), "left").drop("__id"))

    def check_integrity(self) -> DataFrame:
        """(problem, id): ids that edges use and no node has, and ids that several nodes have. Empty for a sound graph."""
        missing = endpoints(self.edges).join(self.nodes.select("id"), "id", "left_anti").select(F.lit("edge end without node").alias("problem"), "id")
        repeated = self.nodes.groupBy("id").count().where("count > 1").select(F.lit("repeated node").alias("problem"), "id")
        return missing.union(repeated)

    def good(self) -> bool:
        """Whether the graph has its reserved series with their types."""
        types = dict(self.nodes.dtypes) | {f"edge.{k}": v for k, v in self.edges.dtypes}
        return types.get("id") == types.get("edge.u") == types.get("edge.v") == "string" and types.get("edge.directed") == "boolean"


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def endpoints(edges: DataFrame) -> DataFrame:
    """(id): the distinct ends of edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
