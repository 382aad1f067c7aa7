"""JSON-logic rules, clause kinds and null strictness."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.jsonlogic import variables
from graphloom.operators import query
from graphloom.plans.names import SeriesName
from graphloom.plans.where import WhereClause
from tests.conftest import four_graphs


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 10, 2.5, "abc", True), (2, None, 0.0, "", False), (3, 30, float("nan"), "17", None), (4, 0, -1.0, None, True)]
    return spark.createDataFrame(rows, "id long, n long, x double, s string, b boolean")


def held(table, rule):
    return [r["id"] for r in table.where(WhereClause.from_rule(rule).condition(table.schema)).orderBy("id").collect()]


N, X, S, B = ({"var": f"edge.{c}"} for c in "nxsb")


@pytest.mark.parametrize(
    ("rule", "ids"),
    [
        ({"==": [N, 10]}, [1]),
        ({"!=": [N, 10]}, [3, 4]),
        ({"==": [S, 17]}, [3]),
        ({"!=": [S, 17]}, [1, 2]),
        ({"===": [S, 17]}, []),
        ({"!==": [S, 17]}, [1, 2, 3]),
        ({"<": [S, 18]}, [3]),
        ({"<": [S, "b"]}, [1, 2, 3]),
        ({"<": [5, N, 20]}, [1]),
        ({"<=": [0, N, 10]}, [1, 4]),
        ({">=": [X, 0]}, [1, 2]),
        ({"==": [X, X]}, [1, 2, 4]),
        ({"==": [B, 1]}, [1, 4]),
        (N, [1, 3]),
        (X, [1, 4]),
        (S, [1, 3]),
        (B, [1, 4]),
        ({"!": [N]}, [4]),
        ({"!!": [S]}, [1, 3]),
        ({"and": [N, {">": [X, 0]}]}, [1]),
        ({"or": [{">": [N, 20]}, {"<": [X, 0]}]}, [3, 4]),
        ({"if": [{">": [N, 20]}, True, {"==": [N, 0]}, True, False]}, [3, 4]),
        ({"?:": [{">": [N, 5]}, False, True]}, [4]),
        ({">": [{"+": [N, 1, 1]}, 11]}, [1, 3]),
        ({"==": [{"-": [N]}, -10]}, [1]),
        ({"==": [{"*": [N, 2]}, 60]}, [3]),
        ({"==": [{"/": [N, 4]}, 2.5]}, [1]),
        ({"/": [1, N]}, [1, 3]),
        ({"==": [{"%": [N, 4]}, 2]}, [1, 3]),
        ({"%": [7, N]}, [1, 3]),
        ({"==": [{"max": [N, 15]}, 15]}, [1, 4]),
        ({"==": [{"min": [N, 15]}, 15]}, [3]),
        ({"in": [N, [10, 0]]}, [1, 4]),
        ({"in": ["b", S]}, [1]),
        ({"in": [S, []]}, []),
        ({"==": [{"cat": [S, "-", N]}, "abc-10"]}, [1]),
        ({"==": [{"substr": [S, 1]}, "bc"]}, [1]),
        ({"==": [{"substr": [S, -1]}, "7"]}, [3]),
        ({"==": [{"substr": [S, 0, -1]}, "ab"]}, [1]),
        ({"==": [{"substr": [S, 1, 1]}, "b"]}, [1]),
        ({"all": [[1, 2], {"<": [{"var": ""}, N]}]}, [1, 3]),
        ({"some": [[10, 99], {"==": [{"var": ""}, N]}]}, [1]),
        ({"none": [[10, 99], {"==": [{"var": ""}, N]}]}, [3, 4]),
        ({"in": [N, {"merge": [[10], 30]}]}, [1, 3]),
        ({"in": [N, {"map": [[5, 15], {"*": [{"var": ""}, 2]}]}]}, [1, 3]),
        ({"<": [{"reduce": [[1, 2, 3], {"+": [{"var": "current"}, {"var": "accumulator"}]}, 0]}, N]}, [1, 3]),
        ({"regex": [S, "^[a-c]+$"]}, [1]),
    ],
)
def test_rules(table, rule, ids):
    assert held(table, rule) == ids


def test_any_null_variable_rejects_a_row(table):
    assert held(table, {"or": [{">": [X, -9]}, {">": [N, 0]}]}) == [1, 3, 4]  # row 2 has no n


def test_unknown_operator_and_lists_are_refused(table):
    with pytest.raises(ValueError, match="unknown operator"):
        held(table, {"frobnicate": [N]})
    with pytest.raises(ValueError, match="lists"):
        held(table, {"==": [N, [1]]})


def test_kinds():
    assert WhereClause.of().kind == "all"
    assert WhereClause.of({"rule": {"==": [{"var": "node.a"}, 1]}}).kind == "node"
    assert WhereClause.of({"==": [N, X]}).kind == "edge"
    assert WhereClause.of({"==": [1, 1]}).kind == "all"
    for bad in ({"==": [{"var": "a"}, 1]}, {"==": [{"var": "node.a"}, N]}, {"==": [{"var": "graph.a"}, 1]}):
        with pytest.raises(ValueError, match="one prefix"):
            WhereClause.of(bad)
        assert WhereClause.of(bad, strict_reference=True).kind == "all"


def test_variables():
    assert variables({"and": [{">": [{"var": "edge.b"}, {"var": ["edge.a", 1]}]}, {"<": [{"var": "edge.b"}, 2]}]}) == ["edge.b", "edge.a"]


def test_file_with_blanks_in_strings(graph, tmp_path):
    path = tmp_path / "rule.json"
    path.write_text(json.dumps({"rule": {"!=": [{"var": "edge.paint"}, "dark blue"]}}))
    assert query.num_edges(graph, str(path)) == 27
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(ValueError, match="no rule"):
        WhereClause.from_file(tmp_path / "none.json")


def many(condition):
    """How many of the rows (s, t, part, load, paint, title, kept, score) meet a condition; nulls do not."""
    return sum(condition(*r) for r in four_graphs())


def test_selectors(graph):
    e, n = graph.edge, graph.node
    assert query.num_edges(graph, (e.part == 1) & (e.score > 50)) == many(lambda s, t, part, *x: part == 1 and x[-1] > 50)
    assert query.num_edges(graph, (e.part != 1) | (e.score < 20)) == many(lambda s, t, part, *x: part != 1 or x[-1] < 20)
    assert query.num_edges(graph, e.paint.isin(["teal", "plum"])) == many(lambda *r: r[4] in ("teal", "plum"))
    assert query.num_edges(graph, e.title.contains("9") & ~(e.part == 0)) == many(lambda *r: "9" in r[5] and r[2] != 0)
    assert query.num_edges(graph, e.u.rlike("^road")) == 6
    assert query.num_nodes(graph, n.id == "road-a") == 1
    assert query.num_edges(graph, (e.score % 2 == 0) & (e.score + 1 > e.score * 1) & (e.score - 1 < e.score / 1)) == many(lambda *r: r[7] % 2 == 0)
    with pytest.raises(TypeError):
        bool(e.part == 1)


def test_callables(graph):
    assert query.num_edges(graph, (["edge.score"], lambda r: r > 70)) == many(lambda *r: r[7] > 70)
    assert query.num_edges(graph, WhereClause.from_callable(["edge.score", "edge.part"], lambda r, g: (r > 70) & (g == 2), pandas=True)) == many(lambda *r: r[7] > 70 and r[2] == 2)
    assert query.num_nodes(graph, (["node.gnum"], lambda g: F.lit(True))) == 7  # null is rejected first


def test_names():
    assert SeriesName.parse("edge.u.age") == SeriesName("edge", "u.age")
    assert SeriesName.parse({"rule": {"var": "node.x"}}) == SeriesName.parse("x", "node")
    for bad in ("x", "graph.x", 3, "edge."):
        with pytest.raises(ValueError, match="series name|not a series"):
            SeriesName.parse(bad)
