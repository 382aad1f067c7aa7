"""Command line: one sub-command for each graph command, and the edge-list converter.

    python -m graphloom.cli create --path graph
    python -m graphloom.cli ingest_parquet_edges --path graph --input_path edges --col_u s --col_v t
    python -m graphloom.cli value_counts --path graph --series_name edge.color --where '{"rule": ...}'

Results are printed as JSON. A failing command prints its message and exits with 1.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession

from graphloom.operators import components, degree, mutate, query, sample, traverse
from graphloom.plans.names import NODE, SeriesName
from graphloom.sources import ingest, sinks
from graphloom.sources.store import GraphStore, copy_graph, remove_graph

ALIASES = ("meta", "metadata", "fields", "addl_series")
LEVELS = {0: "ALL", 10: "DEBUG", 20: "INFO", 30: "WARN", 40: "ERROR", 50: "FATAL"}


def _options(args: argparse.Namespace) -> dict[str, Any]:
    return {k: v for k, v in vars(args).items() if k not in ("command", "path", "loglevel", "overwrite_store") and v is not None}


def _rows(df: Any) -> list[dict]:
    return [json.loads(r["json"]) for r in query.rows_json(df).collect()]


def _reading(store: GraphStore) -> dict[str, Callable[..., Any]]:
    g = store.graph

    def select(which: Callable, series_names: Sequence[str] | None = None, limit: int = 1000, where: Any = None) -> list[dict]:
        return _rows(which(g, series_names, limit, where))

    def select_sample(which: Callable, k: int, series_names: Sequence[str] | None = None, seed: int | None = None, where: Any = None) -> list[dict]:
        return _rows(which(g, k, series_names, seed, where))

    return {
        "describe": lambda where=None: query.describe(g, where),
        "select_edges": lambda **o: select(query.select_edges, **o),
        "select_nodes": lambda **o: select(query.select_nodes, **o),
        "nunique": lambda series_names=None, where=None: query.nunique(g, series_names, where),
        "value_counts": lambda series_name, k=100, where=None: [[r[0], r[1]] for r in query.value_counts(g, series_name, k, where).collect()],
        "topk": lambda series, k=10, where=None, series_names=(): query.rows_arrays(query.topk(g, series, k, series_names, where)),
        "select_sample_edges": lambda **o: select_sample(sample.select_sample_edges, **o),
        "select_sample_nodes": lambda **o: select_sample(sample.select_sample_nodes, **o),
        "dump_parquet_edges": lambda output_path, series_names=None, overwrite=False: sinks.dump_edges(g, output_path, series_names, overwrite),
        "dump_parquet_nodes": lambda output_path, series_names=None, overwrite=False: sinks.dump_nodes(g, output_path, series_names, overwrite),
        "stats": lambda: query.describe(g) | {"series": g.selector_info()},
        "check": lambda: [r.asDict() for r in g.check_integrity().limit(1000).collect()],
    }


def _output(name: str) -> SeriesName:
    return SeriesName.parse(name, NODE)


#: Commands that change the graph: (graph, options) to the new graph, alone or with a result.
WRITING: dict[str, Callable[..., Any]] = {
    "ingest_parquet_edges": lambda g, input_path, col_u, col_v, directed=True, series_names=None, recursive=True: ingest.ingest_parquet_edges(g, input_path, col_u, col_v, directed, series_names, recursive),
    "ingest_csv_edges": lambda g, input_path, col_u, col_v, directed=True, series_names=None: ingest.ingest_csv_edges(g, input_path, col_u, col_v, directed, series_names),
    "in_degree": lambda g, output, where=None: degree.in_degree(g, _output(output), where),
    "out_degree": lambda g, output, where=None: degree.out_degree(g, _output(output), where),
    "degrees": lambda g, in_output, out_output, where=None: degree.degrees(g, _output(in_output), _output(out_output), where),
    "nhops": lambda g, output, nhops, seeds, where=None: traverse.nhops(g, _output(output), nhops, seeds, where),
    "connected_components": lambda g, output, where=None: components.components(g, _output(output), where),
    "sample_edges": lambda g, series_name, k, seed=None, where=None: sample.sample_edges(g, series_name, k, seed, where),
    "sample_nodes": lambda g, series_name, k, seed=None, where=None: sample.sample_nodes(g, series_name, k, seed, where),
    "assign": lambda g, series_name, value, where=None: mutate.assign(g, series_name, value, where),
    "add_series": lambda g, series_name, kind="string": mutate.add_series(g, series_name, kind),
    "add_faker": lambda g, series_name, generator_type, where=None, seed=None: mutate.add_generated(g, series_name, generator_type, where, seed),
    "drop_series": lambda g, series_name: mutate.drop_series(g, series_name),
    "rename_series": lambda g, old_name, new_name: mutate.rename_series(g, old_name, new_name),
    "erase_edges": lambda g, where=None, series_name=None, erase_list=None: mutate.erase_edges(g, where, series_name, erase_list),
}

_ARGUMENTS: dict[str, dict[str, Any]] = {
    "--input_path": {}, "--output_path": {}, "--col_u": {}, "--col_v": {}, "--undirected": {"action": "store_const", "const": False, "dest": "directed"},
    "--series_names": {"type": lambda x: x.split(",")}, "--series_name": {}, "--series": {}, "--where": {"type": json.loads}, "--limit": {"type": int}, "--k": {"type": int},
    "--seed": {"type": int}, "--output": {}, "--in_output": {}, "--out_output": {}, "--nhops": {"type": int}, "--seeds": {"type": lambda x: x.split(",")},
    "--value": {"type": json.loads}, "--kind": {}, "--generator_type": {}, "--old_name": {}, "--new_name": {}, "--erase_list": {"type": lambda x: x.split(",")},
    "--overwrite": {"action": "store_const", "const": True}, "--recursive": {"action": "store_const", "const": True},
    **{f"--{name}": {"type": lambda x: x.split(",")} for name in ("meta", "metadata", "fields", "addl_series")},
}


def run(spark: SparkSession, command: str, path: str, **options: Any) -> Any:
    """Run a command on the graph stored at ``path`` and return its result.

    The commands' own names of options are taken too: ``metadata``, ``meta``, ``fields`` and ``addl_series`` for ``series_names``.
    """
    options = {("series_names" if name in ALIASES else name): value for name, value in options.items()}
    if command == "create":
        GraphStore(spark, path, overwrite=options.get("overwrite", False))
        return {"path": path}
    if command == "copy":
        return copy_graph(spark, path, options["output_path"])
    if command == "remove":
        return remove_graph(spark, path)
    if command == "convert":  # an edge list to a new graph, whatever was there; without names of series the ends alone
        options = {"col_u": "u", "col_v": "v", "series_names": [], "recursive": False} | options
        path = path or options["input_path"].rstrip("/").rpartition("/")[2].removesuffix(".parquet")
        store = GraphStore(spark, path, overwrite=True)
        counts = store.update(WRITING["ingest_parquet_edges"], **options)
        return counts | query.describe(store.graph) | {"edge_series": store.graph.edge_series()}
    store = GraphStore(spark, path, create=False)
    if command in WRITING:
        return store.update(WRITING[command], **options)
    return _reading(store)[command](**options)


def commands() -> list[str]:
    """All command names."""
    probe = _reading(type("NoStore", (), {"graph": None})())
    return sorted(["create", "copy", "remove", "convert", "docs", "welcome", *WRITING, *probe])


def markdown() -> str:
    """The commands that take a stored graph, with their arguments, as Markdown."""
    probe = _reading(type("NoStore", (), {"graph": None})())
    lines = ["| command | arguments | changes the graph |", "| --- | --- | --- |"]
    for name, function in sorted({**probe, **WRITING}.items()):
        given = [str(p) for p in inspect.signature(function).parameters.values() if p.name != "g"]
        lines.append(f"| {name} | {', '.join(given).replace('**o', 'series_names, limit or k, seed, where')} | {'yes' if name in WRITING else 'no'} |")
    return "\n".join(lines)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=commands())
    parser.add_argument("--path", default="")
    parser.add_argument("--loglevel", type=int, default=40)
    for name, how in _ARGUMENTS.items():
        parser.add_argument(name, **{"default": None} | how)
    args = parser.parse_args(argv)
    if args.command == "docs":
        print(markdown())
        return 0
    if args.command == "welcome":
        print(f"graphloom: {len(commands())} commands on property graphs")
        return 0
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    spark.sparkContext.setLogLevel(LEVELS.get(args.loglevel, "ERROR"))
    try:
        print(json.dumps(run(spark, args.command, args.path, **_options(args)), default=str))
    except (ValueError, FileNotFoundError, KeyError, TypeError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
