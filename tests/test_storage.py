"""Ingest, stores, sinks, streams and the command line."""

import json
import math
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions.formatting import shortest_double
from graphloom.operators import mutate, query
from graphloom.plans.graph import PropertyGraph
from graphloom.plans.where import WhereClause
from graphloom.session import delete_path, shared_dir
from graphloom.sources import ingest, sinks
from graphloom.sources.store import ConcurrentChange, GraphStore, copy_graph, remove_graph
from graphloom.streaming.append import append_stream, windowed_counts
from tests.conftest import SCHEMA, four_graphs


@pytest.fixture
def edge_files(spark, tmp_path):
    rows = four_graphs()
    for k in range(4):
        part = spark.createDataFrame([r for r in rows if r[2] == k], SCHEMA)
        part = part.withColumn("load", F.col("load").cast("long")) if k == 3 else part  # files may disagree
        part.coalesce(1).write.parquet(str(tmp_path / "edges" / f"g{k}"))
    return str(tmp_path / "edges")


def test_ingest_parquet(spark, edge_files):
    graph, counts = ingest.ingest_parquet_edges(PropertyGraph.empty(spark), edge_files, "s", "t")
    assert counts == {"num_edges_ingested": 28, "num_nodes_ingested": 21}
    assert dict(graph.edges.dtypes)["load"] == "double" and graph.check_integrity().isEmpty()
    graph, counts = ingest.ingest_parquet_edges(graph, edge_files, "s", "t", False, ["paint", "absent"])
    assert counts == {"num_edges_ingested": 28, "num_nodes_ingested": 0}
    assert query.num_edges(graph) == 56 and graph.edges.where("not directed and load is null").count() == 28
    with pytest.raises(ValueError, match="no such column"):
        ingest.ingest_parquet_edges(graph, edge_files, "s", "x")


def test_ingest_types_and_warnings(spark):
    rows = spark.sql("select * from values (1, 1.5D, int(3), float(0.25), date'1970-01-03', timestamp'1970-01-01 00:00:01', timestamp_ntz'1970-01-01 00:00:02', array(1)), (2, null, 1, 0f, null, null, null, null) as t(a, b, i, f, d, ts, ntz, arr)")
    graph, counts = ingest.ingest_frames(PropertyGraph.empty(spark), [rows], "a", "b")
    assert counts == {"num_edges_ingested": 1, "num_nodes_ingested": 2}
    assert graph.warnings["row skipped: no u or v"] == 1 and any("arr" in w for w in graph.warnings)
    assert tuple(graph.edges.first()) == ("1", "1.5", True, 3, 0.25, 2, 1_000_000, 2_000_000)
    with pytest.raises(ValueError, match="reserved"):
        ingest.ingest_frames(PropertyGraph.empty(spark), [rows.withColumn("u", F.lit(1))], "a", "b")
    with pytest.raises(ValueError, match="series i is"):
        ingest.ingest_frames(graph, [rows.withColumn("i", F.lit("x"))], "a", "b")


def test_ingest_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("src,dst,age\na,b,17\nb,ü`'\",30\nc,,1\n", encoding="utf-8")
    graph, counts = ingest.ingest_csv_edges(PropertyGraph.empty(spark), str(tmp_path / "x.csv"), "src", "dst")
    assert counts["num_edges_ingested"] == 2 and query.num_edges(graph, graph.edge.age < 20) == 1
    ingest.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "pq"), 2)
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3


@pytest.mark.parametrize(("value", "text"), [(1.1, "1.1"), (1.0, "1"), (10000.0, "10000"), (100000.0, "1e+05"), (123456.0, "123456"), (1e20, "1e+20"), (1.5e-7, "1.5e-07"), (0.001, "0.001"), (0.0001, "1e-04"), (0.00012, "0.00012"), (-2.5, "-2.5"), (0.0, "0"), (-0.0, "-0"), (1e300, "1e+300"), (12345678.9, "12345678.9"), (math.inf, "inf"), (-math.inf, "-inf"), (math.nan, "nan"), (1e22, "1e+22"), (1.7976931348623157e308, "1.7976931348623157e+308"), (5e-324, "5e-324")])
def test_shortest_double(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(shortest_double(F.col("x"))).first()[0] == text


def test_store(spark, edge_files, tmp_path):
    path = str(tmp_path / "graph")
    store = GraphStore(spark, path)
    assert store.update(ingest.ingest_parquet_edges, edge_files, "s", "t")["num_edges_ingested"] == 28
    nodes = store.manifest["nodes"]
    store.update(mutate.assign, "edge.x", 1, {"==": [{"var": "edge.part"}, 2]})
    assert store.manifest["nodes"] == nodes  # only the changed table is written
    again = GraphStore(spark, path, create=False)
    assert query.describe(again.graph) == {"nv": 21, "ne": 28, "path": path} and again.good()
    copy_graph(spark, path, str(tmp_path / "copy"))
    assert GraphStore(spark, str(tmp_path / "copy")).graph.edges.where("x = 1").count() == 10
    assert again.vacuum() and query.num_edges(again.graph) == 28
    assert query.describe(GraphStore(spark, path, overwrite=True).graph)["ne"] == 0
    assert remove_graph(spark, path) and not remove_graph(spark, path)
    with pytest.raises(FileNotFoundError):
        GraphStore(spark, path, create=False)
    with pytest.raises(FileNotFoundError):
        copy_graph(spark, path, str(tmp_path / "other"))


def test_ingest_adds_parts(spark, edge_files, tmp_path):
    path = str(tmp_path / "graph")
    store = GraphStore(spark, path)
    store.update(ingest.ingest_parquet_edges, edge_files, "s", "t")
    files = {f: f.stat().st_size for f in (tmp_path / "graph").rglob("*.parquet")}
    counts = store.update(ingest.ingest_parquet_edges, edge_files, "s", "t", True, ["load"])
    assert counts == {"num_edges_ingested": 28, "num_nodes_ingested": 0}
    more = {f: f.stat().st_size for f in (tmp_path / "graph").rglob("*.parquet")}
    assert files.items() <= more.items()  # nothing was written again
    assert sum(spark.read.parquet(str(f)).count() for f in more if f not in files) == 28
    again = GraphStore(spark, path, create=False)
    assert query.describe(again.graph) == {"nv": 21, "ne": 56, "path": path} and again.good() and again.graph.edges.where("paint is null").count() == 29
    assert again.compact() == ["nodes", "edges"] and again.compact() == []
    assert again.vacuum() and query.describe(again.graph)["ne"] == 56
    store.update(mutate.assign, "edge.x", 1)  # a store that was opened before goes on from the newest graph
    assert GraphStore(spark, path).graph.edges.where("x = 1").count() == 56


def test_names_change_without_rows(spark, edge_files, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.update(ingest.ingest_parquet_edges, edge_files, "s", "t")
    files = set((tmp_path / "graph").rglob("*.parquet"))
    before = sorted(map(tuple, store.graph.edges.select("u", "v", "score", "paint").collect()), key=str)
    store.update(mutate.rename_series, "edge.score", "points")
    store.update(mutate.rename_series, "edge.paint", "score")  # a name that a column in the files has had
    store.update(mutate.drop_series, "edge.title")
    store.update(mutate.rename_series, "edge.points", "title")
    again = GraphStore(spark, str(tmp_path / "graph")).graph
    assert sorted(map(tuple, again.edges.select("u", "v", "title", "score").collect()), key=str) == before
    assert set(again.edges.columns) == {"u", "v", "directed", "part", "load", "score", "kept", "title"} and dict(again.edges.dtypes)["title"] == "bigint"
    assert set((tmp_path / "graph").rglob("*.parquet")) == files  # nothing was written
    store.update(ingest.ingest_parquet_edges, edge_files, "s", "t", True, ["load"])
    assert query.describe(store.graph)["ne"] == 56 and store.graph.edges.where("title is null").count() == 28


def test_no_change_is_lost(spark, edge_files, tmp_path):
    first = GraphStore(spark, str(tmp_path / "graph"))
    first.update(ingest.ingest_parquet_edges, edge_files, "s", "t")
    second, before = GraphStore(spark, str(tmp_path / "graph")), first.graph
    second.update(mutate.assign, "edge.x", 1)
    with pytest.raises(ConcurrentChange):
        first.save(mutate.assign(before, "edge.y", 1), before)
    first.update(mutate.assign, "edge.y", 1)
    assert {"x", "y"} <= set(GraphStore(spark, str(tmp_path / "graph")).graph.edges.columns)


def test_rule_files_of_any_file_system(spark, tmp_path):
    (tmp_path / "rule.json").write_text('{"rule": {"==": [{"var": "edge.part"}, 1]}}')
    for name in (str(tmp_path / "rule.json"), f"file://{tmp_path}/rule.json"):
        assert WhereClause.of(name).names == ("edge.part",)


def test_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session)


def test_dump(spark, graph, tmp_path):
    made = sinks.dump_edges(graph, str(tmp_path / "e"), ["paint", "edge.score", "nothing"])
    assert made["rows_written"] == 28 and made["warnings"] == {"unknown series: edge.nothing": 1}
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["u", "v", "directed", "paint", "score"]
    assert sinks.dump_nodes(graph, str(tmp_path / "n"), where=graph.node.gnum == 3)["rows_written"] == 7
    assert spark.read.parquet(str(tmp_path / "n")).columns == ["id", "gnum"]
    with pytest.raises(Exception, match="exist"):
        sinks.dump_nodes(graph, str(tmp_path / "n"))
    assert sinks.dump_nodes(graph, str(tmp_path / "n"), [], overwrite=True)["rows_written"] == 21


def test_row_writer(spark, tmp_path):
    path = str(tmp_path / "rows")
    with sinks.RowWriter(spark, path, "id:i, score:f, name:s, active:b, big:u", batch_rows=100) as writer:
        writer.write_rows([(k, k / 2, None if k % 7 == 0 else f"n{k}", k % 2 == 0, (1 << 64) - 1) for k in range(450)])
        for bad in ((1, 2.0, "x", True), (1.5, 2.0, "x", True, 1), (1, 2.0, "x", 1, 1), (1, 2.0, "x", True, -1), (True, 2.0, "x", True, 1)):
            with pytest.raises((ValueError, TypeError)):
                writer.write_row(bad)
    read = spark.read.parquet(path)
    assert read.count() == 450 and read.where("name is null").count() == 65 and len(list((tmp_path / "rows").glob("*.parquet"))) == 5
    with pytest.raises(ValueError, match="closed"):
        writer.write_row((1, 2.0, "x", True, 1))
    for bad in ("a", "a:x", "a:i,a:s", ":i", []):
        with pytest.raises(ValueError, match="field|type"):
            sinks.parse_fields(bad)
    sinks.write_frame(read, str(tmp_path / "again"), ["id:s", "score|f".replace("|", ":")])
    assert dict(spark.read.parquet(str(tmp_path / "again")).dtypes) == {"id": "string", "score": "double"}


def test_append_stream(spark, edge_files, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    (tmp_path / "drop").mkdir()
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "drop"))
    for k in range(2):
        spark.createDataFrame([r for r in four_graphs() if r[2] == k], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "drop" / str(k)))
    for _ in range(2):  # the second start finds nothing new
        append_stream(store, rows, "s", "t", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert query.describe(store.graph)["ne"] == 12 and query.describe(store.graph)["nv"] == 9
    assert store.manifest["streams"] == {str(tmp_path / "check"): 1}


def test_windowed_counts(spark):
    rows = spark.createDataFrame([(0, "a"), (30, "a"), (59, "b"), (60, "a")], "t long, kind string").withColumn("ts", F.timestamp_seconds("t"))
    found = {(r["start"].minute, r["value"]): r["count"] for r in windowed_counts(rows, "ts", "kind", "1 minute", "10 minutes").collect()}
    assert found == {(0, "a"): 2, (0, "b"): 1, (1, "a"): 1}


def test_commands(spark, edge_files, tmp_path, capsys):
    path = str(tmp_path / "graph")
    run = lambda command, **options: cli.run(spark, command, path, **options)
    run("create")
    assert run("ingest_parquet_edges", input_path=edge_files, col_u="s", col_v="t")["num_nodes_ingested"] == 21
    assert run("describe") == {"nv": 21, "ne": 28, "path": path}
    run("assign", series_name="node.gnum", value=3, where={"rule": {"==": [{"var": "edge.part"}, 3]}})
    assert run("nunique", series_names=["node.gnum"]) == {"node.gnum": 1}
    assert run("value_counts", series_name="edge.part", k=1) == [[2, 10]]
    assert run("topk", series="edge.score", k=2, series_names=["edge.v"]) == [[r[7], r[1]] for r in sorted(four_graphs(), key=lambda r: (-r[7], r[1]))[:2]]
    run("in_degree", output="in")
    run("out_degree", output="node.out")
    run("nhops", output="hops", nhops=2, seeds=["road-a"])
    run("connected_components", output="comp")
    assert run("nunique", series_names=["node.comp", "node.hops"]) == {"node.comp": 4, "node.hops": 3}
    assert len(run("select_edges", limit=5)) == 5 and set(run("select_nodes", series_names=["id"])[0]) == {"node.id"}
    run("sample_edges", series_name="picked", k=4, seed=1)
    run("sample_nodes", series_name="node.picked", k=3)
    assert len(run("select_sample_edges", k=4)) == 4 and len(run("select_sample_nodes", k=3, series_names=["node.id"])) == 3
    run("add_faker", series_name="node.who", generator_type="name")
    run("rename_series", old_name="node.who", new_name="person")
    run("drop_series", series_name="node.person")
    run("add_series", series_name="node.spare", kind="double")
    run("erase_edges", series_name="edge.paint", erase_list=["teal"])
    left = sum(r[4] != "teal" for r in four_graphs())
    assert run("describe")["ne"] == left and run("check") == [] and "edge.v.gnum" in run("stats")["series"]
    assert run("dump_parquet_nodes", output_path=str(tmp_path / "n"))["rows_written"] == 21
    assert run("dump_parquet_edges", output_path=str(tmp_path / "e"), series_names=["paint"])["rows_written"] == left
    run("copy", output_path=str(tmp_path / "copy"))
    assert run("remove") and not run("remove")
    assert run("convert", input_path=edge_files, col_u="s", col_v="t", directed=False, meta=["paint"], recursive=True)["edge_series"] == ["edge.u", "edge.v", "edge.directed", "edge.paint"]
    assert run("convert", input_path=f"{edge_files}/g1", col_u="s", col_v="t")["edge_series"] == ["edge.u", "edge.v", "edge.directed"]
    with pytest.raises(Exception, match="(?i)schema|not exist|not found"):
        run("convert", input_path=edge_files, col_u="s", col_v="t")  # folders are gone through on request only
    run("create", overwrite=True)
    run("ingest_parquet_edges", input_path=edge_files, col_u="s", col_v="t", metadata=["score"])
    assert run("topk", series="edge.score", k=1, addl_series=["edge.u"]) == [[r[7], r[0]] for r in sorted(four_graphs(), key=lambda r: (-r[7], r[0]))[:1]]
    assert run("dump_parquet_edges", output_path=str(tmp_path / "f"), fields=["score"])["rows_written"] == 28
    assert cli.main(["welcome"]) == 0 and "commands" in capsys.readouterr().out
    assert cli.main(["docs"]) == 0 and "| nhops | output, nhops, seeds, where=None | yes |" in capsys.readouterr().out
    assert len(cli.commands()) >= 27


def test_command_line(spark, edge_files, tmp_path, capsys):
    path = str(tmp_path / "graph")
    assert cli.main(["convert", "--path", path, "--input_path", edge_files, "--col_u", "s", "--col_v", "t", "--undirected", "--recursive", "--meta", "part,paint"]) == 0
    assert json.loads(capsys.readouterr().out)["ne"] == 28
    assert cli.main(["select_edges", "--path", path, "--where", '{"rule": {"==": [{"var": "edge.part"}, 1]}}', "--series_names", "edge.u"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 6
    assert cli.main(["drop_series", "--path", path, "--series_name", "edge.u"]) == 1
    assert "reserved" in capsys.readouterr().err
    assert cli.main(["describe", "--path", str(tmp_path / "none")]) == 1


def test_delete_path(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert delete_path(spark, str(tmp_path / "x")) and not delete_path(spark, str(tmp_path / "x"))


def test_llm_is_imported_by_nothing_else():
    found = subprocess.run(["grep", "-rlE", r"graphloom\.llm|from graphloom import llm", "--include=*.py", "graphloom"], capture_output=True, text=True).stdout.split()
    assert [f for f in found if not f.startswith("graphloom/llm/")] == []
