"""Registered queries of the graph engine on graphs derived from the benchmark tables, with DuckDB SQL.

OP: line items as order -> part edges, directed. CO: orders as customer - order edges, undirected.
UE: events as user -> event type edges. GEO: the tree customer -> nation -> region.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import components, degree, mutate, query, records, sample, traverse
from graphloom.plans.graph import PropertyGraph
from graphloom.plans.where import WhereClause
from graphloom.session import FileSystem, fresh_path
from graphloom.sources import ingest, sinks
from graphloom.sources.store import GraphStore, copy_graph, remove_graph

SEEDS = ["O1", "O2", "P7"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("order"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_shipdate").alias("shipdate"),
    )


def _graph(rows: DataFrame, u: str, v: str, directed: bool) -> PropertyGraph:
    return PropertyGraph.from_edges(ingest.prepare_edges(rows, u, v, directed, None, Counter()))


def op_graph(spark: SparkSession, sf_dir: str, directed: bool = True) -> PropertyGraph:
    """Orders and parts, an edge per line item."""
    return _graph(_rows_op(spark, sf_dir), "order", "part", directed)


def co_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and orders, undirected."""
    rows = _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("order"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("totalprice"),
    )
    return _graph(rows, "customer", "order", False)


def ue_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users and event types."""
    rows = _read(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"), F.col("event_type").alias("type"), F.col("value").alias("amount"), "ts")
    return _graph(rows, "user", "type", True)


def geo_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers in nations in regions."""
    customers = _read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("b"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    nations = _read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("b"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("double").alias("balance"))
    return _graph(customers.unionByName(nations), "a", "b", True)


def flat(df: DataFrame) -> DataFrame:
    """Column names without dots."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


# where-clauses used below, as rules
BIG = {">=": [{"var": "edge.quantity"}, 45]}
RETURNED = {"==": [{"var": "edge.returnflag"}, "R"]}
BUSY = {"or": [{">=": [{"var": "node.in"}, 32]}, {">=": [{"var": "node.out"}, 5]}]}


def _busy(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return degree.degrees(op_graph(spark, sf_dir), "node.in", "node.out")


def _gnum(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """OP with a node series that is 3 at the ends of big edges and null elsewhere."""
    return mutate.assign(op_graph(spark, sf_dir), "node.gnum", 3, BIG)


def _edges_json(rule: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: flat(query.select_edges(op_graph(s, d), ["edge.u", "edge.v", "edge.linenumber"], where=rule))


OP = """
op AS (
  SELECT 'O' || l_orderkey AS u, 'P' || l_partkey AS v, true AS directed, l_quantity AS quantity, l_discount AS discount, l_returnflag AS returnflag,
         l_linestatus AS linestatus, l_linenumber::BIGINT AS linenumber, epoch_us(l_shipdate) AS shipdate FROM lineitem
), opn AS (SELECT u AS id FROM op UNION SELECT v FROM op)
"""
CO = "co AS (SELECT 'C' || o_custkey AS u, 'O' || o_orderkey AS v, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS totalprice FROM orders)"
DEG = """
deg AS (SELECT id, coalesce(i, 0)::BIGINT AS i, coalesce(o, 0)::BIGINT AS o FROM opn
  LEFT JOIN (SELECT v AS id, count(*) AS i FROM op GROUP BY v) USING (id) LEFT JOIN (SELECT u AS id, count(*) AS o FROM op GROUP BY u) USING (id)),
busy AS (SELECT id FROM deg WHERE i >= 32 OR o >= 5)
"""


def _jl(condition: str) -> str:
    return f"WITH {OP} SELECT u AS edge_u, v AS edge_v, linenumber AS edge_linenumber FROM op WHERE {condition}"


def _hops(edges: str, hops: int, seeds: list[str], both: bool, graph: str = OP, nodes: str = "opn") -> str:
    listed = ", ".join(f"'{s}'" for s in seeds)
    ways = f"SELECT u AS src, v AS dst FROM {edges}" + (f" UNION SELECT v, u FROM {edges}" if both else "")
    return f"""WITH RECURSIVE {graph}, ways AS (SELECT DISTINCT src, dst FROM ({ways})), reach(id, d) AS (
  SELECT DISTINCT src, 0 FROM ways WHERE src IN ({listed}) UNION SELECT dst, d + 1 FROM reach JOIN ways ON src = id WHERE d < {hops})
SELECT id AS node_id, hops AS node_hops FROM {nodes} LEFT JOIN (SELECT id, min(d)::BIGINT AS hops FROM reach GROUP BY id) USING (id)"""


def _cc(edges: str, alone: str | None = None, graph: str = OP, nodes: str = "opn") -> str:
    more = f" UNION SELECT id, id FROM {alone}" if alone else ""
    return f"""WITH RECURSIVE {graph}, e AS (SELECT u AS a, v AS b FROM {edges} UNION SELECT v, u FROM {edges}{more}), cc(id, comp) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM e
  UNION SELECT p.id, min(c.comp) FROM cc c JOIN e ON e.a = c.id JOIN recurring.cc p ON p.id = e.b WHERE c.comp < p.comp GROUP BY p.id)
SELECT id AS node_id, comp AS node_comp FROM {nodes} LEFT JOIN cc USING (id)"""


def _edge_key(seed: int) -> str:
    """SQL of the sampling key of the order-part edges."""
    columns = ("u", "v", "directed", "quantity", "discount", "returnflag", "linestatus", "linenumber", "shipdate")
    parts = ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"md5(concat_ws(',', '{seed}', {parts}))"


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, dict[str, int]]:
    rows = _rows_op(spark, sf_dir)
    return ingest.ingest_frames(PropertyGraph.empty(spark), [rows], "order", "part", True)


def _parquet_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = ingest.ingest_parquet_edges(PropertyGraph.empty(spark), f"{sf_dir}/orders.parquet", "o_custkey", "o_orderkey", False, ["o_orderstatus", "o_totalprice", "o_orderdate"])
    return flat(query.select_edges(graph))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = _ingested(spark, sf_dir)
    return spark.createDataFrame([(counts["num_edges_ingested"], counts["num_nodes_ingested"])], "num_edges long, num_nodes long")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that is created, ingested, changed and reopened from its path."""
    path = fresh_path(spark, "store")
    store = GraphStore(spark, path)
    store.update(ingest.ingest_frames, [_rows_op(spark, sf_dir)], "order", "part")
    store.update(mutate.assign, "edge.big", True, BIG)
    store.update(mutate.erase_edges, RETURNED)
    return query.value_counts(GraphStore(spark, path, create=False).graph, "edge.big")


def _ingested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingests into one store, the second with a series of its own."""
    store, rows = GraphStore(spark, fresh_path(spark, "store")), _rows_op(spark, sf_dir)
    first = store.update(ingest.ingest_frames, [rows.where("linenumber <= 3").drop("shipdate")], "order", "part")
    second = store.update(ingest.ingest_frames, [rows.where("linenumber > 3")], "order", "part")
    found = query.value_counts(GraphStore(spark, store.path, create=False).graph, "edge.linenumber")
    return found.withColumn("new_nodes", F.lit(first["num_nodes_ingested"] + second["num_nodes_ingested"]))


def _copied_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is compacted, copied and then removed: what is left of both."""
    store = GraphStore(spark, fresh_path(spark, "store"))
    for nation in (True, False):
        rows = geo_graph(spark, sf_dir).edges.where(F.col("segment").isNull() == nation)
        store.update(ingest.ingest_frames, [rows.select("u", "v", "segment")], "u", "v")
    store.compact()
    store.vacuum()
    target = fresh_path(spark, "store")
    copy_graph(spark, store.path, target)
    removed = remove_graph(spark, store.path)
    copied = GraphStore(spark, target, create=False)
    return query.describe_frame(copied.graph).withColumns({"good": F.lit(copied.good()), "removed": F.lit(removed and not remove_graph(spark, store.path))})


def _written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations through the row writer."""
    path = fresh_path(spark, "rows")
    with sinks.RowWriter(spark, path, "key:i, name:s, region:b, half:f", batch_rows=10) as writer:
        writer.write_rows((r[0], r[1], True, r[0] / 2) for r in _read(spark, sf_dir, "region").toLocalIterator())
        writer.write_rows((r[0], r[1], False, None) for r in _read(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator())
    return spark.read.parquet(path)


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in nested folders through the converter, with one series."""
    path = fresh_path(spark, "convert")
    for status in ("F", "O", "P"):
        co_graph(spark, sf_dir).edges.where(F.col("status") == status).select("u", "v", "status", "priority").write.parquet(f"{path}/in/{status}/x")
    cli.run(spark, "convert", f"{path}/graph", input_path=f"{path}/in", directed=False, meta=["status"], recursive=True)
    return flat(query.select_edges(GraphStore(spark, f"{path}/graph", create=False).graph))


def _rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A where-clause from a file in the shared folder."""
    path = fresh_path(spark, "rule") + ".json"
    path = path if "://" in path else f"file://{path}"
    FileSystem(spark, path).create_text(path, json.dumps({"rule": BIG}))
    return flat(query.select_edges(op_graph(spark, sf_dir), ["edge.u", "edge.v"], where=path))


def _command_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topk and stats commands on a stored graph."""
    path = fresh_path(spark, "store")
    GraphStore(spark, path).update(ingest.ingest_frames, [_rows_op(spark, sf_dir).select("order", "part", "quantity", "linenumber")], "order", "part")
    rows = cli.run(spark, "topk", path, series="edge.quantity", k=5, addl_series=["edge.u", "edge.v"])
    stats = cli.run(spark, "stats", path)
    return spark.createDataFrame([(*r, stats["nv"], len(stats["series"])) for r in rows], "quantity double, u string, v string, nv long, series long")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph without most of its orders and with some parts twice."""
    graph = op_graph(spark, sf_dir)
    nodes = graph.nodes.where("id like 'P%' or id like 'O%7'")
    return graph.replace(nodes=nodes.union(nodes.where("id like 'P%1'"))).check_integrity()


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series, whether some exist, and fields of edges and nodes by key."""
    graph = _gnum(spark, sf_dir)
    rows = [(s, graph.has_series(s), graph.selector_info()[s]) for s in [*graph.node_series(), *graph.edge_series()]]
    return spark.createDataFrame([*rows, ("edge.nothing", graph.has_series("edge.nothing"), None)], "series string, known boolean, kind string")


def _edge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge values set by (u, v) from a table, read back for the edges of some parts."""
    graph, rows = op_graph(spark, sf_dir), _rows_op(spark, sf_dir)
    rates = rows.where("discount > 0.05").groupBy(F.col("order").alias("u"), F.col("part").alias("v")).agg(F.max("discount").alias("value"))
    graph = graph.set_values("edge.rate", rates)
    wanted = graph.edges.where("v like 'P%3'").select("u", "v")
    return flat(graph.get_edges(wanted, ["edge.u", "edge.v", "edge.linenumber", "edge.rate"]))


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node and two edges added one by one to a stored graph."""
    store = GraphStore(spark, fresh_path(spark, "store"))
    store.update(ingest.ingest_frames, [_rows_op(spark, sf_dir).select("order", "part", "quantity")], "order", "part")
    store.update(records.add_node, "lonely")
    store.update(records.add_edge, "lonely", "P1", quantity=99)
    store.update(records.add_edge, "new", "newer", False)
    return flat(query.select_edges(store.graph, where={"in": [{"var": "edge.u"}, ["lonely", "new", "O1"]]})).withColumn("nodes", F.lit(query.num_nodes(store.graph)))


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "dump")
    sinks.dump_edges(op_graph(spark, sf_dir), path, ["edge.quantity", "edge.returnflag"])
    return spark.read.parquet(path)


def _dumped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "dump")
    sinks.dump_nodes(degree.in_degree(op_graph(spark, sf_dir), "node.in"), path)
    return spark.read.parquet(path)


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = degree.in_degree(op_graph(spark, sf_dir), "node.in")
    return flat(query.topk(graph, "node.in", 10, ["node.id"]))


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flagship": (_flagship, f"WITH {OP} SELECT count(*)::BIGINT AS node_in, v AS node_id FROM op GROUP BY v ORDER BY 1 DESC, 2 LIMIT 10"),
    # sources
    "ingest_edges": (lambda s, d: flat(query.select_edges(_ingested(s, d)[0])), f"WITH {OP} SELECT u AS edge_u, v AS edge_v, directed AS edge_directed, quantity AS edge_quantity, discount AS edge_discount, returnflag AS edge_returnflag, linestatus AS edge_linestatus, linenumber AS edge_linenumber, shipdate AS edge_shipdate FROM op"),
    "ingest_nodes": (lambda s, d: flat(query.select_nodes(_ingested(s, d)[0])), f"WITH {OP} SELECT id AS node_id FROM opn"),
    "ingest_counts": (_counts, f"WITH {OP} SELECT (SELECT count(*) FROM op)::BIGINT AS num_edges, (SELECT count(*) FROM opn)::BIGINT AS num_nodes"),
    "ingest_parquet": (_parquet_ingested, "SELECT o_custkey::VARCHAR AS edge_u, o_orderkey::VARCHAR AS edge_v, false AS edge_directed, o_orderstatus AS edge_o_orderstatus, o_totalprice AS edge_o_totalprice, epoch_us(o_orderdate) AS edge_o_orderdate FROM orders"),
    "store_reopened": (_stored, f"WITH {OP} SELECT CASE WHEN quantity >= 45 THEN true END AS value, count(*)::BIGINT AS count FROM op WHERE returnflag <> 'R' GROUP BY 1"),
    "ingest_twice": (_ingested_twice, f"WITH {OP} SELECT linenumber AS value, count(*)::BIGINT AS count, (SELECT count(*) FROM opn)::INT AS new_nodes FROM op GROUP BY 1"),
    "store_copied": (_copied_store, "WITH g AS (SELECT 'C' || c_custkey AS u, 'N' || c_nationkey AS v FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation) SELECT (SELECT count(*) FROM (SELECT u FROM g UNION SELECT v FROM g))::BIGINT AS nv, (SELECT count(*) FROM g)::BIGINT AS ne, true AS good, true AS removed"),
    "row_writer": (_written_rows, "SELECT r_regionkey::BIGINT AS key, r_name AS name, true AS region, r_regionkey / 2 AS half FROM region UNION ALL SELECT n_nationkey, n_name, false, NULL FROM nation"),
    "converter": (_converted, f"WITH {CO} SELECT u AS edge_u, v AS edge_v, false AS edge_directed, status AS edge_status FROM co"),
    "rule_file": (_rule_file, f"WITH {OP} SELECT u AS edge_u, v AS edge_v FROM op WHERE quantity >= 45"),
    "commands": (_command_rows, f"WITH {OP} SELECT quantity, u, v, (SELECT count(*) FROM opn)::BIGINT AS nv, 8::BIGINT AS series FROM op ORDER BY quantity DESC, u, v LIMIT 5"),
    "integrity_broken": (_broken, f"WITH {OP} SELECT 'edge end without node' AS problem, id FROM opn WHERE id LIKE 'O%' AND id NOT LIKE 'O%7' UNION ALL SELECT 'repeated node', id FROM opn WHERE id LIKE 'P%1'"),
    "catalogue": (_catalogue, "SELECT unnest(['node.id', 'node.gnum', 'edge.u', 'edge.v', 'edge.directed', 'edge.quantity', 'edge.discount', 'edge.returnflag', 'edge.linestatus', 'edge.linenumber', 'edge.shipdate', 'edge.nothing']) AS series, unnest([true, true, true, true, true, true, true, true, true, true, true, false]) AS known, unnest(['string', 'bigint', 'string', 'string', 'boolean', 'double', 'double', 'string', 'string', 'bigint', 'bigint', NULL]) AS kind"),
    "edge_cells": (_edge_cells, f"WITH {OP}, r AS (SELECT u, v, max(discount) AS rate FROM op WHERE discount > 0.05 GROUP BY u, v) SELECT op.u AS edge_u, op.v AS edge_v, linenumber AS edge_linenumber, rate AS edge_rate FROM op LEFT JOIN r ON op.u = r.u AND op.v = r.v WHERE op.v LIKE 'P%3'"),
    "added_records": (_added, f"WITH {OP}, n AS (SELECT count(*) + 3 AS n FROM opn) SELECT u AS edge_u, v AS edge_v, directed AS edge_directed, quantity AS edge_quantity, n::INT AS nodes FROM (SELECT u, v, directed, quantity FROM op WHERE u = 'O1' UNION ALL VALUES ('lonely', 'P1', true, 99.0::DOUBLE), ('new', 'newer', false, NULL)), n"),
    "dump_edges": (_dumped, f"WITH {OP} SELECT u, v, directed, quantity, returnflag FROM op"),
    "dump_nodes": (_dumped_nodes, f"""WITH {OP}, {DEG} SELECT id, i AS "in" FROM deg"""),
    "integrity_check": (lambda s, d: op_graph(s, d).check_integrity(), "SELECT '' AS problem, '' AS id WHERE false"),
    # selection
    "select_edges_ewhere": (lambda s, d: flat(query.select_edges(op_graph(s, d), ["edge.u", "edge.v", "edge.quantity"], where=BIG)), f"WITH {OP} SELECT u AS edge_u, v AS edge_v, quantity AS edge_quantity FROM op WHERE quantity >= 45"),
    "select_nodes_nwhere": (lambda s, d: flat(query.select_nodes(_busy(s, d), where=BUSY)), f"WITH {OP}, {DEG} SELECT id AS node_id, i AS node_in, o AS node_out FROM deg SEMI JOIN busy USING (id)"),
    "select_edges_nwhere": (lambda s, d: flat(query.select_edges(_busy(s, d), ["edge.u", "edge.v", "edge.linenumber"], where=BUSY)), f"WITH {OP}, {DEG} SELECT u AS edge_u, v AS edge_v, linenumber AS edge_linenumber FROM op WHERE u IN (FROM busy) AND v IN (FROM busy)"),
    "select_nodes_ewhere": (lambda s, d: flat(query.select_nodes(op_graph(s, d), where=BIG)), f"WITH {OP} SELECT u AS node_id FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45"),
    "select_limit": (lambda s, d: query.select_edges(op_graph(s, d), ["edge.u"], limit=1000).agg(F.count("*").alias("n")), f"WITH {OP} SELECT least(1000, count(*))::BIGINT AS n FROM op"),
    "select_udf_where": (lambda s, d: flat(query.select_edges(op_graph(s, d), ["edge.u", "edge.v"], where=WhereClause.from_callable(["edge.quantity", "edge.discount"], lambda q, x: (q > 40) & (x < 0.05)))), f"WITH {OP} SELECT u AS edge_u, v AS edge_v FROM op WHERE quantity > 40 AND discount < 0.05"),
    "select_pandas_where": (lambda s, d: flat(query.select_edges(op_graph(s, d), ["edge.u", "edge.v"], where=WhereClause.from_callable(["edge.quantity"], lambda q: q % 7 == 0, pandas=True))), f"WITH {OP} SELECT u AS edge_u, v AS edge_v FROM op WHERE quantity % 7 = 0"),
    "inherited_selector": (lambda s, d: flat(query.select_edges(_busy(s, d), ["edge.u", "edge.v"], where={">=": [{"var": "edge.v.in"}, 35]})), f"WITH {OP}, {DEG} SELECT u AS edge_u, v AS edge_v FROM op JOIN deg ON v = id WHERE i >= 35"),
    "rows_json": (lambda s, d: query.rows_json(query.select_nodes(_gnum(s, d))), f"""WITH {OP} SELECT '{{"node.id":"' || id || '"' || CASE WHEN id IN (SELECT u FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45) THEN ',"node.gnum":3' ELSE '' END || '}}' AS json FROM opn"""),
    "describe_all": (lambda s, d: query.describe_frame(op_graph(s, d)), f"WITH {OP} SELECT (SELECT count(*) FROM opn)::BIGINT AS nv, (SELECT count(*) FROM op)::BIGINT AS ne"),
    "describe_ewhere": (lambda s, d: query.describe_frame(op_graph(s, d), BIG), f"WITH {OP}, b AS (SELECT * FROM op WHERE quantity >= 45) SELECT (SELECT count(*) FROM (SELECT u FROM b UNION SELECT v FROM b))::BIGINT AS nv, (SELECT count(*) FROM b)::BIGINT AS ne"),
    "describe_nwhere": (lambda s, d: query.describe_frame(_busy(s, d), BUSY), f"WITH {OP}, {DEG} SELECT (SELECT count(*) FROM busy)::BIGINT AS nv, (SELECT count(*) FROM op WHERE u IN (FROM busy) AND v IN (FROM busy))::BIGINT AS ne"),
    "subgraph_edges": (lambda s, d: flat(query.select_edges(op_graph(s, d).subgraph(RETURNED), ["edge.u", "edge.v"])), f"WITH {OP} SELECT u AS edge_u, v AS edge_v FROM op WHERE returnflag = 'R'"),
    # predicates
    "where_null_strict": (lambda s, d: flat(query.select_nodes(_gnum(s, d), where={"or": [{"!=": [{"var": "node.gnum"}, 4]}, {"!=": [{"var": "node.id"}, ""]}]})), f"WITH {OP} SELECT id AS node_id, 3::BIGINT AS node_gnum FROM (SELECT u AS id FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45)"),
    "where_missing_series": (lambda s, d: flat(query.select_nodes(op_graph(s, d), where={">": [{"var": "node.nothing"}, 1]})), f"WITH {OP} SELECT id AS node_id FROM opn WHERE false"),
    "where_constant": (lambda s, d: flat(query.select_nodes(op_graph(s, d), where={"==": [1, 0]})), f"WITH {OP} SELECT id AS node_id FROM opn WHERE false"),
    "jl_compare": (_edges_json({"<": [10, {"var": "edge.quantity"}, 12]}), _jl("quantity > 10 AND quantity < 12")),
    "jl_mixed_types": (_edges_json({"==": [{"var": "edge.linenumber"}, "3"]}), _jl("linenumber = 3")),
    "jl_strict_types": (_edges_json({"or": [{"===": [{"var": "edge.linenumber"}, "3"]}, {"===": [{"var": "edge.returnflag"}, "N"]}]}), _jl("returnflag = 'N'")),
    "jl_logic": (_edges_json({"and": [{"!": [RETURNED]}, {"or": [BIG, {"<": [{"var": "edge.discount"}, 0.02]}]}]}), _jl("returnflag <> 'R' AND (quantity >= 45 OR discount < 0.02)")),
    "jl_if": (_edges_json({"if": [RETURNED, {">": [{"var": "edge.quantity"}, 30]}, {"==": [{"var": "edge.linestatus"}, "O"]}, True, False]}), _jl("CASE WHEN returnflag = 'R' THEN quantity > 30 WHEN linestatus = 'O' THEN true ELSE false END")),
    "jl_arithmetic": (_edges_json({">": [{"*": [{"var": "edge.quantity"}, {"-": [1, {"var": "edge.discount"}]}]}, {"+": [{"/": [{"var": "edge.quantity"}, 2]}, {"%": [{"var": "edge.linenumber"}, 3]}, 20]}]}), _jl("quantity * (1 - discount) > quantity / 2 + linenumber % 3 + 20")),
    "jl_min_max": (_edges_json({"<": [{"max": [{"var": "edge.linenumber"}, 3]}, {"min": [{"var": "edge.quantity"}, 6]}]}), _jl("greatest(linenumber, 3) < least(quantity, 6)")),
    "jl_missing": (_edges_json({"and": [{"!": [{"missing": ["edge.quantity", "edge.discount"]}]}, {"!": [{"missing_some": [1, ["edge.quantity", "edge.nothing"]]}]}, {"missing": ["edge.nothing"]}, BIG]}), _jl("quantity >= 45")),
    "jl_map_filter": (_edges_json({"in": [{"var": "edge.linenumber"}, {"map": [[0, 1, 2], {"*": [{"var": ""}, 3]}]}]}), _jl("linenumber IN (0, 3, 6)")),
    "jl_reduce": (_edges_json({"<": [{"reduce": [[1, 2, 3], {"+": [{"var": "current"}, {"var": "accumulator"}]}, {"var": "edge.linenumber"}]}, 9]}), _jl("6 + linenumber < 9")),
    "jl_all_none": (_edges_json({"and": [{"all": [[1, 2], {"<=": [{"var": ""}, {"var": "edge.linenumber"}]}]}, {"none": [[3, 5], {"==": [{"var": ""}, {"var": "edge.linenumber"}]}]}]}), _jl("linenumber >= 2 AND linenumber NOT IN (3, 5)")),
    "jl_merge": (_edges_json({"in": [{"var": "edge.linenumber"}, {"merge": [[1, 2], 5, [7]]}]}), _jl("linenumber IN (1, 2, 5, 7)")),
    "jl_in": (_edges_json({"and": [{"in": [{"var": "edge.returnflag"}, ["R", "A"]]}, {"in": ["9", {"var": "edge.v"}]}]}), _jl("returnflag IN ('R', 'A') AND contains(v, '9')")),
    "jl_text": (_edges_json({"==": [{"cat": [{"substr": [{"var": "edge.v"}, -2]}, "-", {"substr": [{"var": "edge.u"}, 0, 2]}]}, "17-O1"]}), _jl("right(v, 2) || '-' || left(u, 2) = '17-O1'")),
    "jl_lists": (_edges_json({"some": [[1, 4, 7], {"==": [{"var": ""}, {"var": "edge.linenumber"}]}]}), _jl("linenumber IN (1, 4, 7)")),
    "jl_regex": (_edges_json({"regex": [{"var": "edge.u"}, "^O[0-9]*7$"]}), _jl("regexp_matches(u, '^O[0-9]*7$')")),
    "jl_truthiness": (_edges_json({"!!": [{"var": "edge.discount"}]}), _jl("discount <> 0")),
    # aggregates
    "num_edges": (lambda s, d: s.createDataFrame([(query.num_edges(op_graph(s, d), BIG),)], "n long"), f"WITH {OP} SELECT count(*)::BIGINT AS n FROM op WHERE quantity >= 45"),
    "nunique_edge": (lambda s, d: query.nunique_frame(op_graph(s, d), ["edge.u", "edge.v", "edge.quantity", "edge.returnflag", "edge.directed"]), f"WITH {OP} SELECT unnest(['edge.u', 'edge.v', 'edge.quantity', 'edge.returnflag', 'edge.directed']) AS series, unnest([count(DISTINCT u), count(DISTINCT v), count(DISTINCT quantity), count(DISTINCT returnflag), 1])::BIGINT AS n FROM op"),
    "nunique_node": (lambda s, d: query.nunique_frame(_gnum(s, d), ["node.id", "node.gnum"]), f"WITH {OP} SELECT unnest(['node.id', 'node.gnum']) AS series, unnest([count(*), 1])::BIGINT AS n FROM opn"),
    "nunique_where": (lambda s, d: query.nunique_frame(op_graph(s, d), ["edge.u", "node.id"], BIG), f"WITH {OP}, b AS (SELECT * FROM op WHERE quantity >= 45) SELECT 'edge.u' AS series, count(DISTINCT u)::BIGINT AS n FROM b UNION ALL SELECT 'node.id', count(*) FROM (SELECT u FROM b UNION SELECT v FROM b)"),
    "value_counts": (lambda s, d: query.value_counts(op_graph(s, d), "edge.quantity"), f"WITH {OP} SELECT quantity AS value, count(*)::BIGINT AS count FROM op GROUP BY 1"),
    "value_counts_top": (lambda s, d: query.value_counts(op_graph(s, d), "edge.v", 20), f"WITH {OP} SELECT v AS value, count(*)::BIGINT AS count FROM op GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "value_counts_bottom": (lambda s, d: query.value_counts(op_graph(s, d), "edge.v", -20), f"WITH {OP} SELECT v AS value, count(*)::BIGINT AS count FROM op GROUP BY 1 ORDER BY 2, 1 LIMIT 20"),
    "value_counts_null": (lambda s, d: query.value_counts(_gnum(s, d), "node.gnum"), f"WITH {OP}, b AS (SELECT u AS id FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45) SELECT CASE WHEN b.id IS NOT NULL THEN 3 END::BIGINT AS value, count(*)::BIGINT AS count FROM opn LEFT JOIN b USING (id) GROUP BY 1"),
    "value_counts_hubs": (lambda s, d: query.value_counts(ue_graph(s, d), "edge.v", where={">": [{"var": "edge.amount"}, 50]}), "SELECT event_type AS value, count(*)::BIGINT AS count FROM events WHERE value > 50 GROUP BY 1"),
    "topk_edges": (lambda s, d: flat(query.topk(op_graph(s, d), "edge.quantity", 15, ["edge.shipdate", "edge.u", "edge.v"])), f"WITH {OP} SELECT quantity AS edge_quantity, shipdate AS edge_shipdate, u AS edge_u, v AS edge_v FROM op ORDER BY 1 DESC, 2, 3, 4 LIMIT 15"),
    "topk_nodes": (lambda s, d: flat(query.topk(_busy(s, d), "node.out", 12, ["node.id"], order="asc")), f"WITH {OP}, {DEG} SELECT o AS node_out, id AS node_id FROM deg ORDER BY 1, 2 LIMIT 12"),
    "topk_where": (lambda s, d: flat(query.topk(op_graph(s, d), "edge.discount", 10, ["edge.u", "edge.v"], RETURNED)), f"WITH {OP} SELECT discount AS edge_discount, u AS edge_u, v AS edge_v FROM op WHERE returnflag = 'R' ORDER BY 1 DESC, 2, 3 LIMIT 10"),
    # degrees
    "in_degree": (lambda s, d: flat(query.select_nodes(degree.in_degree(op_graph(s, d), "node.in"))), f"WITH {OP}, {DEG} SELECT id AS node_id, i AS node_in FROM deg"),
    "out_degree": (lambda s, d: flat(query.select_nodes(degree.out_degree(op_graph(s, d), "node.out"))), f"WITH {OP}, {DEG} SELECT id AS node_id, o AS node_out FROM deg"),
    "degrees": (lambda s, d: flat(query.select_nodes(_busy(s, d))), f"WITH {OP}, {DEG} SELECT id AS node_id, i AS node_in, o AS node_out FROM deg"),
    "degree_undirected": (lambda s, d: flat(query.select_nodes(degree.degrees(co_graph(s, d), "node.in", "node.out"))), f"WITH {CO}, e AS (SELECT u AS id FROM co UNION ALL SELECT v FROM co) SELECT id AS node_id, count(*)::BIGINT AS node_in, count(*)::BIGINT AS node_out FROM e GROUP BY id"),
    "degree_ewhere": (lambda s, d: flat(query.select_nodes(degree.in_degree(op_graph(s, d), "node.in", BIG))), f"WITH {OP}, b AS (SELECT * FROM op WHERE quantity >= 45), t AS (SELECT u AS id FROM b UNION SELECT v FROM b), c AS (SELECT v AS id, count(*) AS n FROM b GROUP BY v) SELECT opn.id AS node_id, CASE WHEN t.id IS NOT NULL THEN coalesce(n, 0) END::BIGINT AS node_in FROM opn LEFT JOIN t USING (id) LEFT JOIN c USING (id)"),
    "degree_nwhere": (lambda s, d: flat(query.select_nodes(degree.out_degree(_busy(s, d), "node.within", BUSY), ["node.id", "node.within"])), f"WITH {OP}, {DEG}, c AS (SELECT u AS id, count(*) AS n FROM op WHERE u IN (FROM busy) AND v IN (FROM busy) GROUP BY u) SELECT opn.id AS node_id, CASE WHEN busy.id IS NOT NULL THEN coalesce(n, 0) END::BIGINT AS node_within FROM opn LEFT JOIN busy USING (id) LEFT JOIN c USING (id)"),
    "degree_tree": (lambda s, d: flat(query.select_nodes(degree.degrees(geo_graph(s, d), "node.in", "node.out"))), "WITH g AS (SELECT 'C' || c_custkey AS u, 'N' || c_nationkey AS v FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), n AS (SELECT u AS id FROM g UNION SELECT v FROM g) SELECT id AS node_id, (SELECT count(*) FROM g WHERE v = id)::BIGINT AS node_in, (SELECT count(*) FROM g WHERE u = id)::BIGINT AS node_out FROM n"),
    # algorithms
    "nhops_directed": (lambda s, d: flat(query.select_nodes(traverse.nhops(geo_graph(s, d), "node.hops", 2, ["C1", "C2", "N3"]))), _hops("g", 2, ["C1", "C2", "N3"], False, "g AS (SELECT 'C' || c_custkey AS u, 'N' || c_nationkey AS v FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), gn AS (SELECT u AS id FROM g UNION SELECT v FROM g)", "gn")),
    "nhops_undirected": (lambda s, d: flat(query.select_nodes(traverse.nhops(op_graph(s, d, False), "node.hops", 3, SEEDS))), _hops("op", 3, SEEDS, True)),
    "nhops_where": (lambda s, d: flat(query.select_nodes(traverse.nhops(op_graph(s, d, False), "node.hops", 4, SEEDS, RETURNED, "ignore"))), _hops("(SELECT * FROM op WHERE returnflag = 'R')", 4, SEEDS, True)),
    "cc_full": (lambda s, d: flat(query.select_nodes(components.components(op_graph(s, d), "node.comp"))), _cc("op")),
    "cc_ewhere": (lambda s, d: flat(query.select_nodes(components.components(op_graph(s, d), "node.comp", BIG))), _cc("(SELECT * FROM op WHERE quantity >= 45)")),
    "cc_nwhere": (lambda s, d: flat(query.select_nodes(components.components(_busy(s, d), "node.comp", BUSY), ["node.id", "node.comp"])), _cc("(SELECT * FROM op WHERE u IN (FROM busy) AND v IN (FROM busy))", "busy", f"{OP}, {DEG}")),
    # samples
    "sample_edges": (lambda s, d: flat(query.select_edges(sample.sample_edges(op_graph(s, d), "edge.picked", 500, 7), ["edge.u", "edge.v", "edge.linenumber", "edge.picked"])), f"WITH {OP} SELECT u AS edge_u, v AS edge_v, linenumber AS edge_linenumber, CASE WHEN row_number() OVER (ORDER BY {_edge_key(7)}) <= 500 THEN true END AS edge_picked FROM op"),
    "sample_nodes": (lambda s, d: flat(query.select_nodes(sample.sample_nodes(op_graph(s, d), "node.picked", 200, 7, BIG))), f"WITH {OP}, t AS (SELECT u AS id FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45), p AS (SELECT id FROM t ORDER BY md5('7,' || length(id) || ':' || id) LIMIT 200) SELECT opn.id AS node_id, CASE WHEN p.id IS NOT NULL THEN true END AS node_picked FROM opn LEFT JOIN p USING (id)"),
    "select_sample_edges": (lambda s, d: flat(sample.select_sample_edges(op_graph(s, d), 50, ["edge.u", "edge.v"], 3, RETURNED)), f"WITH {OP} SELECT u AS edge_u, v AS edge_v FROM op WHERE returnflag = 'R' ORDER BY {_edge_key(3)} LIMIT 50"),
    "select_sample_nodes": (lambda s, d: flat(sample.select_sample_nodes(op_graph(s, d), 50, seed=8)), f"WITH {OP} SELECT id AS node_id FROM opn ORDER BY md5('8,' || length(id) || ':' || id) LIMIT 50"),
    # changes
    "assign_edge": (lambda s, d: flat(query.select_edges(mutate.assign(op_graph(s, d), "edge.rate", 0.5, BIG), ["edge.u", "edge.v", "edge.rate"])), f"WITH {OP} SELECT u AS edge_u, v AS edge_v, CASE WHEN quantity >= 45 THEN 0.5::DOUBLE END AS edge_rate FROM op"),
    "assign_edge_nwhere": (lambda s, d: flat(query.select_edges(mutate.assign(_busy(s, d), "edge.within", True, BUSY), ["edge.u", "edge.v", "edge.within"])), f"WITH {OP}, {DEG} SELECT u AS edge_u, v AS edge_v, CASE WHEN u IN (FROM busy) AND v IN (FROM busy) THEN true END AS edge_within FROM op"),
    "assign_node_ewhere": (lambda s, d: flat(query.select_nodes(_gnum(s, d))), f"WITH {OP}, b AS (SELECT u AS id FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45) SELECT opn.id AS node_id, CASE WHEN b.id IS NOT NULL THEN 3 END::BIGINT AS node_gnum FROM opn LEFT JOIN b USING (id)"),
    "erase_ewhere": (lambda s, d: query.describe_frame(mutate.erase_edges(op_graph(s, d), RETURNED)), f"WITH {OP} SELECT (SELECT count(*) FROM opn)::BIGINT AS nv, (SELECT count(*) FROM op WHERE returnflag <> 'R')::BIGINT AS ne"),
    "erase_nwhere": (lambda s, d: flat(query.select_edges(mutate.erase_edges(_busy(s, d), BUSY), ["edge.u", "edge.v"])), f"WITH {OP}, {DEG} SELECT u AS edge_u, v AS edge_v FROM op WHERE NOT (u IN (FROM busy) AND v IN (FROM busy))"),
    "erase_list": (lambda s, d: flat(query.select_edges(mutate.erase_edges(op_graph(s, d), series="edge.returnflag", values=["R", "N"]), ["edge.u", "edge.v"])), f"WITH {OP} SELECT u AS edge_u, v AS edge_v FROM op WHERE returnflag NOT IN ('R', 'N')"),
    "add_series": (lambda s, d: flat(query.select_nodes(mutate.add_series(op_graph(s, d), "node.empty", "double"))), f"WITH {OP} SELECT id AS node_id, NULL::DOUBLE AS node_empty FROM opn"),
    "drop_series": (lambda s, d: flat(query.select_edges(mutate.drop_series(co_graph(s, d), "edge.priority"))), f"WITH {CO} SELECT u AS edge_u, v AS edge_v, false AS edge_directed, status AS edge_status, totalprice AS edge_totalprice FROM co"),
    "rename_series": (lambda s, d: flat(query.select_edges(mutate.rename_series(co_graph(s, d), "edge.priority", "urgency"), ["edge.v", "edge.urgency"])), f"WITH {CO} SELECT v AS edge_v, priority AS edge_urgency FROM co"),
    "set_values": (lambda s, d: flat(query.select_nodes(records.set_values(op_graph(s, d), "node.size", _read(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("long").alias("value"))))), f"WITH {OP} SELECT id AS node_id, p_size::BIGINT AS node_size FROM opn LEFT JOIN part ON id = 'P' || p_partkey"),
    "unset_cells": (lambda s, d: query.value_counts(records.unset(op_graph(s, d), "edge.linestatus", BIG), "edge.linestatus"), f"WITH {OP} SELECT CASE WHEN quantity < 45 THEN linestatus END AS value, count(*)::BIGINT AS count FROM op GROUP BY 1"),
    "series_values": (lambda s, d: records.series_values(_gnum(s, d), "node.gnum"), f"WITH {OP} SELECT 3::BIGINT AS value FROM (SELECT u FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45)"),
    "load_factors": (lambda s, d: records.load_factors(_gnum(s, d), "node").select("series", "records", "filled"), f"WITH {OP}, b AS (SELECT u FROM op WHERE quantity >= 45 UNION SELECT v FROM op WHERE quantity >= 45) SELECT 'node.id' AS series, count(*)::BIGINT AS records, count(*)::BIGINT AS filled FROM opn UNION ALL SELECT 'node.gnum', (SELECT count(*) FROM opn), count(*) FROM b"),
    "get_records": (lambda s, d: flat(records.get_records(_busy(s, d), ["P1", "P2", "O1", "X9"])), f"WITH {OP}, {DEG} SELECT id AS node_id, i AS node_in, o AS node_out FROM deg WHERE id IN ('P1', 'P2', 'O1', 'X9')"),
    "remove_nodes": (lambda s, d: query.describe_frame(records.remove_nodes(_busy(s, d), BUSY)), f"WITH {OP}, {DEG} SELECT (SELECT count(*) FROM opn ANTI JOIN busy USING (id))::BIGINT AS nv, (SELECT count(*) FROM op WHERE u NOT IN (FROM busy) AND v NOT IN (FROM busy))::BIGINT AS ne"),
    "generator_series": (lambda s, d: flat(query.select_nodes(mutate.add_generated(op_graph(s, d), "node.who", "email", seed=5))), None),
    "generator_shape": (lambda s, d: mutate.add_generated(op_graph(s, d), "edge.p", "int_percentage", BIG, 3).edges.agg(F.count("*").alias("n"), F.count("p").alias("filled"), F.count_if(F.expr("p between 0 and 100")).alias("fit")), f"WITH {OP} SELECT count(*)::BIGINT AS n, count(*) FILTER (quantity >= 45)::BIGINT AS filled, count(*) FILTER (quantity >= 45)::BIGINT AS fit FROM op"),
    "generator_function": (lambda s, d: mutate.add_generated(op_graph(s, d), "node.n", lambda rows: rows * 0 + 7, kind="long").nodes.groupBy("n").count(), f"WITH {OP} SELECT 7::BIGINT AS n, count(*)::BIGINT AS count FROM opn"),
    "copy_edges_csv": (lambda s, d: _csv_round_trip(s, d), f"WITH {CO} SELECT u AS edge_u, v AS edge_v, false AS edge_directed, status AS edge_status, totalprice AS edge_totalprice FROM co"),
}


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV, converted to Parquet and ingested."""
    path = fresh_path(spark, "csv")
    co_graph(spark, sf_dir).edges.select("u", "v", "status", "totalprice").write.option("header", True).csv(f"{path}/csv")
    ingest.csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet")
    graph, _ = ingest.ingest_parquet_edges(PropertyGraph.empty(spark), f"{path}/parquet", "u", "v", False)
    return flat(query.select_edges(graph))


QUERIES = {name: run for name, (run, _) in Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in Q.items() if sql is not None}
