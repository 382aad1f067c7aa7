"""One local session for all tests, and four small graphs."""

from __future__ import annotations

from itertools import combinations, pairwise

import pytest
from pyspark.sql import SparkSession

from graphloom.operators import mutate
from graphloom.plans.graph import PropertyGraph
from graphloom.sources.ingest import ingest_frames

SCHEMA = "s string, t string, part long, load double, paint string, title string, kept boolean, score long"
PAINTS = ("ochre", "teal", "plum", "sand", "moss")


def four_graphs() -> list[tuple]:
    """A ring with a chord, all pairs of four, all pairs of five, and a road: 21 vertices, 28 edges."""
    shapes = {
        "ring": [*pairwise("abcde"), ("e", "a"), ("a", "c")],
        "four": list(combinations("abcd", 2)),
        "five": list(combinations("abcde", 2)),
        "road": list(pairwise("abcdefg")),
    }
    rows = [(name, part, a, b) for part, (name, pairs) in enumerate(shapes.items()) for a, b in pairs]
    paint = lambda k: None if k == 8 else PAINTS[k * k % 7 % 5]
    return [(f"{name}-{a}", f"{name}-{b}", part, 1.0, paint(k), f"e{k}", part % 2 == 1, (k * 37 + 11) % 50 * 2 + (k % 3 == 0)) for k, (name, part, a, b) in enumerate(rows)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def graph(spark) -> PropertyGraph:
    """The four graphs, with node.gnum = 3 at the ends of the road's edges."""
    made, _ = ingest_frames(PropertyGraph.empty(spark), [spark.createDataFrame(four_graphs(), SCHEMA)], "s", "t")
    return mutate.assign(made, "node.gnum", 3, made.edge.part == 3)
