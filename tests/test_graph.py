"""Operators on the four small graphs, against values counted from their rows."""

import json
import random
from functools import partial
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from graphloom.operators import components, degree, mutate, query, records, sample, traverse
from graphloom.plans.graph import PropertyGraph
from graphloom.sources.ingest import ingest_frames
from tests.conftest import PAINTS, SCHEMA, four_graphs


def series(graph, name, prefix="node"):
    return {r[0]: r[1] for r in graph.nodes.select("id", name).collect()} if prefix == "node" else None


def undirected(spark, rows):
    made, _ = ingest_frames(PropertyGraph.empty(spark), [spark.createDataFrame(rows, "s string, t string")], "s", "t", directed=False)
    return made


ROWS = [dict(zip([x.split()[0] for x in SCHEMA.split(", ")], r, strict=True)) for r in four_graphs()]


def values(name, part=None):
    return [r[name] for r in ROWS if part is None or r["part"] == part]


def test_describe(graph, spark):
    assert query.describe(graph) == {"nv": 21, "ne": 28, "path": None}
    assert query.describe(PropertyGraph.empty(spark))["nv"] == 0
    assert query.describe(graph, graph.edge.part == 1) == {"nv": 4, "ne": 6, "path": None}
    assert query.describe(graph, graph.node.gnum == 3) == {"nv": 7, "ne": 6, "path": None}
    assert graph.good() and graph.check_integrity().isEmpty()


def test_integrity_problems(graph):
    broken = graph.replace(nodes=graph.nodes.where("id <> 'road-a'").union(graph.nodes.where("id = 'road-b'")))
    assert {tuple(r) for r in broken.check_integrity().collect()} == {("edge end without node", "road-a"), ("repeated node", "road-b")}


def test_nunique(graph):
    assert query.nunique(graph, ["edge.part", "edge.kept", "edge.score", "node.id", "node.gnum"]) == {"edge.part": 4, "edge.kept": 2, "edge.score": len(set(values("score"))), "node.id": 21, "node.gnum": 1}
    assert query.nunique(graph, ["edge.part", "edge.paint", "node.id", "node.gnum"], graph.edge.part == 3) == {"edge.part": 1, "edge.paint": len(set(values("paint", 3))), "node.id": 7, "node.gnum": 1}
    assert set(query.nunique(graph)) == {*graph.edge_series(), *graph.node_series()}
    with pytest.raises(ValueError, match="no such series"):
        query.nunique(graph, ["edge.nothing"])


def test_value_counts(graph):
    assert {r[0]: r[1] for r in query.value_counts(graph, "edge.part").collect()} == {0: 6, 1: 6, 2: 10, 3: 6}
    assert {r[0]: r[1] for r in query.value_counts(graph, "edge.kept", 5).collect()} == {True: 12, False: 16}
    assert {r[0]: r[1] for r in query.value_counts(graph, "node.gnum").collect()} == {3: 7, None: 14}
    assert [tuple(r) for r in query.value_counts(graph, "edge.part", 2).collect()] == [(2, 10), (0, 6)]
    assert [tuple(r) for r in query.value_counts(graph, "edge.part", -2).collect()] == [(0, 6), (1, 6)]
    assert [tuple(r) for r in query.value_counts(graph, "edge.part", where=graph.edge.part == 0).collect()] == [(0, 6)]


def test_topk(graph):
    assert [r[0] for r in query.topk(graph, "edge.score", 5).collect()] == sorted(values("score"), reverse=True)[:5]
    assert [r[0] for r in query.topk(graph, "edge.score", 10, where=graph.edge.part == 1).collect()] == sorted(values("score", 1), reverse=True)
    assert query.rows_arrays(query.topk(graph, "edge.paint", 28, ["edge.u"]))[-1] == [None, next(r["s"] for r in ROWS if r["paint"] is None)]
    assert [r[0] for r in query.topk(graph, "edge.score", 2, order=F.abs(F.col("score") - 50)).collect()] == sorted(values("score"), key=lambda x: abs(x - 50))[:2]
    with pytest.raises(ValueError, match="not a series of edges"):
        query.topk(graph, "edge.score", extra=["node.id"])
    with pytest.raises(ValueError, match="no such series"):
        query.topk(graph, "edge.nothing")


def test_select(graph):
    assert query.select_edges(graph).count() == 28
    assert query.select_edges(graph, limit=5).count() == 5
    assert query.select_nodes(graph, limit=10).count() == 10
    assert query.select_nodes(graph, ["node.id"], where=graph.edge.part == 1).columns == ["node.id"]
    assert query.select_edges(graph, []).count() == 0
    rows = [json.loads(r["json"]) for r in query.rows_json(query.select_nodes(graph)).collect()]
    assert sum("node.gnum" in r for r in rows) == 7
    for bad in ("node.id", "edge.nothing"):
        with pytest.raises(ValueError, match="series"):
            query.select_edges(graph, [bad])


def test_clauses_across_tables(graph):
    marked = degree.in_degree(graph, "node.in")
    assert {r[0] for r in query.select_nodes(marked, ["node.id"], where=marked.node["in"] > 2).collect()} == {"four-d", "five-d", "five-e"}
    assert [tuple(r) for r in query.select_edges(marked, ["edge.u", "edge.v"], where=marked.node["in"] > 2).collect()] == [("five-d", "five-e")]
    within = series(degree.in_degree(marked, "node.within", marked.node["in"] > 2), "within")
    assert {k: v for k, v in within.items() if v is not None} == {"four-d": 0, "five-d": 0, "five-e": 1}
    assert query.num_edges(marked, marked.edge.v["in"] > 3) == 4  # inherited from the edge's end


def test_missing_series_and_constants(graph):
    fresh = graph.replace()
    assert query.num_edges(fresh, fresh.edge.nothing == 1) == 0
    assert any("does not exist" in w for w in fresh.warnings)
    assert query.num_nodes(graph, {"==": [1, 0]}) == 0
    assert query.num_nodes(graph, {"==": [1, 1]}) == 21
    assert query.num_nodes(graph.replace(strict_reference=True), {"==": [1, 0]}) == 21
    assert query.num_nodes(graph.replace(strict_reference=True), {">": [{"var": "age"}, 60]}) == 21


def test_degrees(graph, spark):
    both = degree.degrees(graph, "in", "node.out")
    assert [series(both, "in")[f"five-{c}"] for c in "abcde"] == [0, 1, 2, 3, 4]
    assert [series(both, "out")[f"five-{c}"] for c in "abcde"] == [4, 3, 2, 1, 0]
    assert series(degree.out_degree(graph, "node.out"), "out") == series(both, "out")
    loop = degree.degrees(undirected(spark, [("a", "a"), ("a", "b")]), "node.in", "node.out")
    assert series(loop, "in") == series(loop, "out") == {"a": 3, "b": 1}
    for bad in ("node.id", "node.gnum", "edge.in"):
        with pytest.raises(ValueError, match="series"):
            degree.in_degree(graph, bad)


def test_nhops(graph, spark):
    found = {k: v for k, v in series(traverse.nhops(graph, "node.hops", 2, ["road-a", "road-f"]), "hops").items() if v is not None}
    assert found == {"road-a": 0, "road-b": 1, "road-c": 2, "road-f": 0, "road-g": 1}
    both = undirected(spark, [(a, b) for a, b in zip("abcdef", "bcdefg", strict=True)])
    found = {k: v for k, v in series(traverse.nhops(both, "node.hops", 2, ["a", "f"]), "hops").items() if v is not None}
    assert found == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1, "f": 0, "g": 1}
    with pytest.raises(ValueError, match="invalid or missing"):
        traverse.nhops(graph, "node.hops", 2, ["road-g"])
    assert set(series(traverse.nhops(graph, "node.hops", 2, ["road-g"], missing="ignore"), "hops").values()) == {None}
    with pytest.raises(ValueError, match="series exists"):
        traverse.nhops(graph, "node.gnum", 2, ["road-a"])


def test_components(graph, spark):
    labels = series(components.components(graph, "node.comp"), "comp")
    assert sorted(list(labels.values()).count(x) for x in set(labels.values())) == [4, 5, 5, 7]
    assert set(labels.values()) == {"road-a", "five-a", "ring-a", "four-a"}
    within = series(components.components(graph, "node.comp", graph.edge.part == 3), "comp")
    assert {v for k, v in within.items() if k.startswith("road")} == {"road-a"} and {v for k, v in within.items() if not k.startswith("road")} == {None}
    alone = series(components.components(graph, "node.comp", graph.node.id.isin(["road-a", "road-b", "road-g"])), "comp")
    assert {k: v for k, v in alone.items() if v} == {"road-a": "road-a", "road-b": "road-a", "road-g": "road-g"}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 900), (500, None)], "u long, v long")
    found = {r["id"]: r["component"] for r in components.connected_components(chain).collect()}
    assert found == {**{k: 0 for k in range(201)}, 900: 900}


def test_components_in_rounds(spark):
    """Hubs and long chains with no edge settled locally, and adaptive execution off."""
    rows = [(k, k + 1) for k in range(60)] + [(1000, 1001 + k) for k in range(400)] + [(1500 + k, 1200 + k) for k in range(40)] + [(7_000, 7_000)]
    edges, before = spark.createDataFrame(rows, "u long, v long").repartition(3), spark.conf.get("spark.sql.adaptive.enabled")
    whole = sorted(map(tuple, components.connected_components(edges).collect()))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(components, "CHUNK", 7)
        patch.setattr(components, "HUB_SHARE", 20)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        try:
            assert sorted(map(tuple, components.connected_components(edges, local_edges=0).collect())) == whole
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {c for _, c in whole} == {0, 1000, 7_000} and len(whole) == 61 + 401 + 40 + 1
    assert components.connected_components(edges.limit(0)).count() == 0


def edges_of_rounds(patch):
    """The numbers of edges that the rounds of components write, as they come."""
    counts, written = [], components._written

    def seen(edges, path):
        found = written(edges, path)
        if "/round-" in path:
            counts.append(found[0].count())
        return found

    patch.setattr(components, "_written", seen)
    patch.setattr(components, "CHUNK", 20)
    return counts


def scattered(copies):
    """(order, part) of graphs without order and parts in common, the copies of an edge one after the other."""
    draw = random.Random(3)
    return [(f"O{k}-{order}", f"P{k}-{draw.randrange(25)}") for order in range(200) for _ in range(4) for k in range(copies)]


def test_rounds_of_components_shrink(spark):
    """Whatever order edges come in, all rounds together write no more than a few times the edges."""
    path = list(pairwise(range(1500)))
    random.Random(5).shuffle(path)
    for rows, kind, parts in ((path, "u long, v long", 1), (scattered(4), "u string, v string", 4)):
        with pytest.MonkeyPatch.context() as patch:
            counts = edges_of_rounds(patch)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
            try:
                found = components.connected_components(spark.createDataFrame(rows, kind), local_edges=0).collect()
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len({r["id"] for r in found}) == len({x for r in rows for x in r})
        assert len({r["component"] for r in found}) == parts
        assert all(r["component"] == min(x["id"] for x in found if x["component"] == r["component"]) for r in found[:40])
        assert len(counts) > 1 and sum(counts) < 2 * len(rows), counts


def test_rounds_under_an_edge_clause_shrink(spark):
    """Sparse selected edges: labels by plain sets, null elsewhere, and rounds that shrink."""
    rows = [(a, b, k % 8) for k, (a, b) in enumerate(scattered(3))]
    least = {x: x for a, b, q in rows if q >= 5 for x in (a, b)}
    for a, b in [(a, b) for _ in range(40) for a, b, q in rows if q >= 5]:
        least[a] = least[b] = min(least[a], least[b])
    made, _ = ingest_frames(PropertyGraph.empty(spark), [spark.createDataFrame(rows, "s string, t string, q long")], "s", "t")
    with pytest.MonkeyPatch.context() as patch:
        counts = edges_of_rounds(patch)
        patch.setattr(components, "connected_components", partial(components.connected_components, local_edges=0))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
        try:
            found = series(components.components(made, "node.comp", made.edge.q >= 5), "comp")
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {x: least.get(x) for a, b, _ in rows for x in (a, b)}
    assert len(counts) > 1 and sum(counts) < 2 * sum(q >= 5 for _, _, q in rows), counts


def shuffled(spark):
    """The number of rows that all stages of the session have shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_components_of_sparse_edges_shuffle_them_once(spark):
    """Orders of one or two parts, dealt at random: every vertex meets its stars in one shuffle, and is named once, whatever its part."""
    draw = random.Random(7)
    rows = [(f"O{order}", f"P{order % 40}-{draw.randrange(30)}") for order in range(6000) for _ in range(1 + order % 2)]
    rows += [(f"Q{k}", f"R{k}") for k in range(300)] + [("S", "S"), ("R7", "R7"), ("R8", "R9"), ("O1", None)]
    draw.shuffle(rows)
    given = [r for r in rows if None not in r]
    least = {x: x for r in given for x in r}
    while any(least[a] != least[b] for a, b in given):
        for a, b in given:
            least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame(rows, "u string, v string").repartition(4).localCheckpoint()
    before, at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = components.connected_components(edges, local_edges=0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == len(least) and dict(map(tuple, found)) == least
    assert shuffled(spark) - at < 3 * len(rows)


def test_samples(graph):
    picked = sample.sample_edges(graph, "edge.picked", 10)
    assert [r[0] for r in picked.edges.select("picked").collect()].count(True) == 10
    assert query.nunique(picked, ["edge.picked"]) == {"edge.picked": 1}
    inside = sample.sample_edges(graph, "edge.picked", 3, where=graph.edge.part == 1).edges.where("picked")
    assert inside.count() == 3 and inside.where("part <> 1").isEmpty()
    assert sample.sample_nodes(graph, "node.picked", 3, where=graph.node.gnum == 3).nodes.where("picked and gnum = 3").count() == 3
    assert sample.sample_nodes(graph, "node.picked", 99).nodes.where("picked").count() == 21
    assert sample.sample_nodes(graph, "node.picked", 0).nodes.where("picked").count() == 0
    ids = lambda seed: {r[0] for r in sample.select_sample_nodes(graph, 8, ["node.id"], seed).collect()}
    assert ids(4) == ids(4) != ids(5) and len(ids(4)) == 8 and ids(None) == ids(0)
    assert {r[0] for r in sample.sample_nodes(graph, "node.picked", 8, 4).nodes.where("picked").select("id").collect()} == ids(4)
    assert sample.select_sample_edges(graph, 6, ["edge.u"]).count() == 6
    with pytest.raises(ValueError, match="no such series"):
        sample.select_sample_edges(graph, 6, ["edge.nothing"])


def test_sample_of_equal_rows_and_by_histogram(spark, monkeypatch):
    rows = [("a", "b")] * 7 + [("c", "d")] * 5
    same = undirected(spark, rows)
    for k in (1, 5, 6, 8, 11, 12, 20):
        assert sample.sample_edges(same, "edge.p", k).edges.where("p").count() == min(k, 12)
    many = undirected(spark, [(f"x{k}", f"y{k}") for k in range(300)])
    plain = {r[0] for r in sample.sample_edges(many, "edge.p", 120, 9).edges.where("p").select("u").collect()}
    monkeypatch.setattr(sample, "DIRECT", 10)
    assert {r[0] for r in sample.sample_edges(many, "edge.p", 120, 9).edges.where("p").select("u").collect()} == plain
    assert sample.select_sample_edges(many, 120, ["edge.u"], 9).count() == 120
    assert sample.sample_edges(same, "edge.p", 11).edges.where("p").count() == 11


def test_assign(graph):
    made = mutate.assign(graph, "edge.rate", 0.5, graph.edge.part == 1)
    assert made.edges.where("rate = 0.5").count() == 6 and made.edges.where("rate is null").count() == 22
    assert mutate.assign(made, "edge.inside", True, made.node.gnum == 3).edges.where("inside").count() == 6
    assert mutate.assign(graph, "node.kind", "x").nodes.where("kind = 'x'").count() == 21
    for name, value in (("node.gnum", 1), ("edge.u", 1), ("gnum", 1), ("node.new", None)):
        with pytest.raises(ValueError, match="serie"):
            mutate.assign(graph, name, value)


def test_schema_changes(graph):
    made = mutate.add_series(graph, "node.x", "double")
    assert dict(made.nodes.dtypes)["x"] == "double" and made.has_series("node.x") and not graph.has_series("node.x")
    renamed = mutate.rename_series(made, "node.x", "y")
    assert renamed.node_series() == ["node.id", "node.gnum", "node.y"]
    assert mutate.drop_series(renamed, renamed.node.y).node_series() == ["node.id", "node.gnum"]
    assert made.selector_info()["edge.u.gnum"] == "bigint"
    for old, new in (("edge.u", "edge.w"), ("edge.paint", "edge.v"), ("edge.paint", "node.paint"), ("edge.nothing", "edge.x"), ("edge.paint", "edge.title")):
        with pytest.raises(ValueError, match="serie"):
            mutate.rename_series(graph, old, new)
    for name in ("node.id", "edge.nothing"):
        with pytest.raises(ValueError, match="serie"):
            mutate.drop_series(graph, name)
    with pytest.raises(ValueError, match="type"):
        mutate.add_series(graph, "node.z", "date")


def test_erase(graph, monkeypatch):
    assert query.describe(mutate.erase_edges(graph, graph.edge.part == 1)) == {"nv": 21, "ne": 22, "path": None}
    assert query.num_edges(mutate.erase_edges(graph)) == 0
    assert query.num_edges(mutate.erase_edges(graph, graph.node.gnum == 3)) == 22
    assert query.num_edges(mutate.erase_edges(graph, series="edge.paint", values=list(PAINTS[:2]))) == 28 - sum(x in PAINTS[:2] for x in values("paint"))
    monkeypatch.setattr(mutate, "INLINE_VALUES", 1)
    kept = mutate.erase_edges(graph, series="edge.paint", values=list(PAINTS[:2]))
    assert query.num_edges(kept) == 28 - sum(x in PAINTS[:2] for x in values("paint")) and kept.edges.where("paint is null").count() == 1
    for options in ({"series": "edge.paint"}, {"series": "edge.score", "values": ["1"]}, {"series": "edge.paint", "values": ["teal"], "where": {"==": [1, 1]}}):
        with pytest.raises(ValueError, match="clause|strings"):
            mutate.erase_edges(graph, **options)


@pytest.mark.parametrize(("name", "check"), [("uuid4", "length(x) = 36"), ("integer", "x between 0 and 10000000"), ("double", "x between 0 and 1e7"), ("percentage", "x between 0 and 100"), ("int_percentage", "x between 0 and 100"), ("two_char_string", "x rlike '^[a-z]{2}$'"), ("bool", "x in (true, false)"), ("name", "x like '% %'"), ("email", "x like '%.%@example.%'"), ("username", "x rlike '^[a-z]+[0-9]+$'")])
def test_generators(graph, name, check):
    made = mutate.add_generated(graph, "node.x", name, graph.node.gnum == 3)
    assert made.nodes.where(check).count() == 7 and made.nodes.where("x is null").count() == 14


def test_own_generators(graph):
    assert mutate.add_generated(graph, "edge.x", F.col("score") * 2).edges.where("x = score * 2").count() == 28
    assert mutate.add_generated(graph, "edge.x", lambda rows: ["v"] * len(rows)).edges.where("x = 'v'").count() == 28
    with pytest.raises(ValueError, match="unknown generator"):
        mutate.add_generated(graph, "edge.x", "nothing")


def test_subgraph(graph):
    part = graph.subgraph(graph.edge.part == 1)
    assert part.nodes.count() == 4 and part.edges.count() == 6


def test_records(graph):
    assert records.get(graph, "road-a", "node.gnum") == 3 and records.is_none(graph, "five-a", "gnum")
    assert records.get_records(graph, ["road-a", "x", "road-a"]).count() == 1
    assert records.series_values(graph, "node.gnum").count() == 7
    assert records.is_series_type(graph, "edge.score", "int64") and not records.is_series_type(graph, "edge.score", str)
    factors = {r["series"]: r["load_factor"] for r in records.load_factors(graph, "node").collect()}
    assert factors == {"node.id": 1.0, "node.gnum": pytest.approx(7 / 21)}
    with pytest.raises(KeyError):
        records.get(graph, "nobody", "node.gnum")


def test_edge_cells(graph):
    assert records.get_edge(graph, "road-a", "road-b", "edge.part") == [3] and records.get_edges(graph, [("road-a", "road-b"), ("x", "y")]).count() == 1
    made = records.set_values(graph, "edge.load", {("road-a", "road-b"): 2.5, ("x", "y"): 1.0})
    assert records.get_edge(made, "road-a", "road-b", "load") == [2.5] and made.edges.where("load = 1").count() == 27 and made.warnings["invalid edges"] == 1
    with pytest.raises(KeyError):
        records.get_edge(graph, "road-b", "road-a", "edge.part")
    with pytest.raises(ValueError, match="several"):
        records.set_values(graph, "edge.x", graph.edges.selectExpr("'a' as u", "'b' as v", "1 as value"))


def test_single_records(graph):
    more = records.add_edge(records.add_node(graph, "alone", gnum=5), "alone", "other", False, load=3)
    assert query.describe(more) == {"nv": 23, "ne": 29, "path": None} and more.check_integrity().isEmpty()
    assert records.get(more, "alone", "node.gnum") == 5 and records.get_edge(more, "alone", "other", "edge.load") == [3.0]
    for call in (lambda: records.add_node(more, "alone"), lambda: records.add_node(graph, "x", nothing=1), lambda: records.add_edge(graph, "x", "y", paint_=1)):
        with pytest.raises(ValueError, match="exists|no such"):
            call()


def test_operations_are_methods(graph):
    assert graph.nunique(["edge.part"], where=graph.edge.part == 1) == {"edge.part": 1}
    assert graph.value_counts("edge.part", 1).first()["count"] == 10
    assert graph.in_degree("node.in").components("node.comp").nunique(["node.comp"]) == {"node.comp": 4}
    assert "nhops" in dir(graph) and not hasattr(graph, "nothing")


def test_set_and_unset(graph):
    made = records.set_values(graph, "node.gnum", {"road-a": 9, "five-a": None, "nobody": 1})
    found = series(made, "gnum")
    assert (found["road-a"], found["road-b"], found["five-a"]) == (9, 3, None) and made.warnings["invalid nodes"] == 1
    assert series(records.set_values(graph, "node.label", {"road-a": "x"}), "label")["road-a"] == "x"
    cleared = records.unset(made, "node.gnum", made.node.id == "road-a")
    assert series(cleared, "gnum")["road-a"] is None and series(cleared, "gnum")["road-b"] == 3
    assert set(series(records.unset(made, "node.gnum"), "gnum").values()) == {None}
    for call in (lambda: records.set_values(graph, "node.id", {"a": "b"}), lambda: records.unset(graph, "edge.u"), lambda: records.set_values(graph, "node.x", graph.edges.selectExpr("'road-a' as id", "score as value"))):
        with pytest.raises(ValueError, match="reserved|several"):
            call()


def test_remove_and_clear(graph):
    left = records.remove_nodes(graph, graph.node.id.isin(["road-c", "ring-c"]))
    assert query.describe(left) == {"nv": 19, "ne": 23, "path": None} and left.check_integrity().isEmpty()
    empty = records.clear(graph)
    assert query.describe(empty) == {"nv": 0, "ne": 0, "path": None} and empty.node_series() == graph.node_series()
    assert records.max_record(graph, "edge") == 28
