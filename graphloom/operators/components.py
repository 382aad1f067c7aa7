"""Connected components of an undirected edge list.

Each partition first replaces its edges by a spanning forest of stars, ``CHUNK`` edges at a time. If
at most ``LOCAL_EDGES`` edges are left, a single task settles them. Otherwise the graph is first reduced to
the centres of the stars: in one shuffle each vertex meets its stars, a vertex that is no centre anywhere
takes the least of its centres, which it links with the others, and only links between centres, cut down
to forests, go on. Second ends of edges are centres before first ends; if these are different vertices, as
in a table of orders and parts, only second ends are left. If that is still too much, rounds contract the
graph: every member of a star takes the centre with the least hash among its stars, both ends of each star
edge are replaced by what they took, and the edges between different centres, again cut down to forests,
are the next round's graph (randomised contraction: Boegeholz, Brand and Todor, "In-database connected
component analysis", ICDE 2020). The hash differs from round to round, so the vertices shrink by a constant
factor whatever their names and order. What each vertex took is kept and followed backwards in the end.

An edge is shuffled once for the first step, and twice a round, by its member and by its centre. A vertex
is a member, and a centre, once a chunk at most; values with more than one in ``HUB_SHARE`` rows, of which
there are at most twice as many, are looked up by a broadcast, so a hub's edges stay where they lie. Each
step is written to the session's shared folder, which cuts lineage and survives lost executors, and is
counted as it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.graph import PropertyGraph
from graphloom.plans.names import NODE
from graphloom.session import delete_path, fresh_path

CHUNK, LOCAL_EDGES, HUB_SHARE = 1_000_000, 1_000_000, 1_000


def settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of i and j; label holds the least member of each set."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _stars(u: pa.Array, v: pa.Array, roots: bool, hashes: tuple[np.ndarray, np.ndarray] | None = None, seconds: bool = False) -> tuple[pa.Array, pa.Array]:
    """(member, centre) of the components of edges; centres themselves too if ``roots`` or if nothing else tells of them.

    The centre is the least member, or that with the least of ``hashes``, with ``seconds`` among the members in v.
    """
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(coded.dictionary)
    if hashes is None:
        order = pc.sort_indices(coded.dictionary).to_numpy()
    else:
        drawn, first = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
        drawn[codes] = np.concatenate(hashes)
        first[codes[: len(u)]] = True
        first[codes[len(u) :]] = False
        order = np.lexsort((drawn, first)) if seconds else np.argsort(drawn, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    ends = rank[codes]
    i, j = ends[: len(u)], ends[len(u) :]
    label = settle(np.arange(n), i, j)
    shown = label != np.arange(n)
    alone = np.ones(n, dtype=bool)
    alone[label[shown]] = False
    at = np.arange(n) if roots else np.flatnonzero(shown | alone)
    names = coded.dictionary.take(pa.array(order))
    return names.take(pa.array(at)), names.take(pa.array(label[at]))


def cut_down(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition, none a loop, as spanning forests of ``chunk`` edges at a time.

    For code that makes edges in Python: ``_forest`` behind it would hold a second Python worker in every task.
    """
    held, size = [], 0

    def made() -> Iterator[pa.RecordBatch]:
        u, v = (pa.concat_arrays([b.column(k) for b in held]) for k in range(2))
        found = pa.RecordBatch.from_arrays(list(_stars(u, v, False)), ["u", "v"])
        yield from (found.slice(k, 100_000) for k in range(0, found.num_rows, 100_000))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= chunk:
            yield from made()
            held, size = [], 0
    if size:
        yield from made()


def _forest(edges: DataFrame, chunk: int, roots: bool = False, seed: int | None = None) -> DataFrame:
    """Edges with the same components, at most one a vertex, partition and chunk; loops for vertices that nothing else tells of.

    They lead to the least vertex or, with a ``seed``, to that with the least hash; seed 0 prefers vertices in v.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> Iterator[pa.RecordBatch]:
            u, v, *h = (pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns))
            stars = _stars(u, v, roots, (h[0].to_numpy(), h[1].to_numpy()) if h else None, seed == 0)
            found = pa.RecordBatch.from_arrays(list(stars), ["u", "v"])
            yield from (found.slice(k, 100_000) for k in range(0, found.num_rows, 100_000))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                yield from made()
                held, size = [], 0
        if size:
            yield from made()

    drawn = [] if seed is None else [F.xxhash64(F.lit(seed), "u").alias("hu"), F.xxhash64(F.lit(seed), "v").alias("hv")]
    return edges.select("u", "v", *drawn).mapInArrow(run, edges.select("u", "v").schema)


def _hubs(rows: DataFrame, key: str, total: int) -> list[Any]:
    """All values of ``key`` with more than one in ``HUB_SHARE`` of ``total`` rows, and at most twice as many values.

    Such a value has more than half that share in some chunks, and what it has in others is no more than that half.
    """
    share = 2 * HUB_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def many() -> pa.RecordBatch:
            counts = pc.value_counts(pa.concat_arrays(held))
            frequent = counts.filter(pc.greater(counts.field(1), size / share))
            return pa.RecordBatch.from_arrays([frequent.field(0), frequent.field(1)], [key, "n"])

        for batch in batches:
            held.append(batch.column(0))
            size += batch.num_rows
            if size >= CHUNK:
                yield many()
                held, size = [], 0
        if size:
            yield many()

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key).mapInArrow(run, f"{key} {kind}, n long").groupBy(key).agg(F.sum("n").alias("n"))
    return [r[0] for r in found.where(F.col("n") > total / share).collect()]


def _lookup(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows``, ``total`` in number, with what ``side`` has of their ``key``, which is unique there, or null."""
    hubs = _hubs(rows, key, total)
    if not hubs:
        return rows.join(side, key, "left")
    hot = F.col(key).isin(hubs)
    return rows.where(hot).join(F.broadcast(side.where(hot)), key, "left").union(rows.where(~hot).join(side, key, "left"))


def _saved(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _written(edges: DataFrame, path: str) -> tuple[DataFrame, int, int]:
    """The edges as written, the number of those between two vertices, and that of loops."""
    seen = Observation()
    observed = edges.observe(seen, F.count_if(F.col("u") != F.col("v")).alias("n"), F.count_if(F.col("u") == F.col("v")).alias("loops"))
    written, found = _saved(observed, path), seen.get
    return written, found["n"], found["loops"]


def _marked(stars: DataFrame, chunk: int) -> DataFrame:
    """Star edges, and (centre, null) for each centre once a partition and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def marks() -> Iterator[pa.RecordBatch]:
            centres = pc.unique(pa.concat_arrays(held))
            found = pa.RecordBatch.from_arrays([centres, pa.nulls(len(centres), centres.type)], ["u", "v"])
            yield from (found.slice(k, 100_000) for k in range(0, found.num_rows, 100_000))

        for batch in batches:
            yield batch
            held.append(batch.column(1))
            size += batch.num_rows
            if size >= chunk:
                yield from marks()
                held, size = [], 0
        if size:
            yield from marks()

    return stars.select("u", "v").mapInArrow(run, stars.select("u", "v").schema)


def _peel(stars: DataFrame) -> DataFrame:
    """(u, taken) once for each vertex, a centre itself or else the least of its centres, and (taken, v) for links between centres."""
    centres = W.partitionBy("u").orderBy(F.asc_nulls_first("v"))
    ranked = _marked(stars, CHUNK).select("u", "v", F.coalesce(F.first("v").over(centres), "u").alias("taken"), F.row_number().over(centres).alias("k"))
    first = F.col("k") == 1
    return ranked.where("k = 1 or v <> taken").select(F.when(first, F.col("u")).alias("u"), F.when(~first, F.col("v")).alias("v"), "taken")


def _take(stars: DataFrame, seed: int) -> DataFrame:
    """(u, v, taken): star edges with the centre that their member takes; u is left in one row of each member, as is all that is needed."""
    centres = W.partitionBy("u").orderBy(F.xxhash64(F.lit(seed), "v"), "v")
    dealt = stars.repartition("u")  # before the window has its hashes, which would be shuffled too
    ranked = dealt.select("u", "v", F.first("v").over(centres).alias("taken"), F.row_number().over(centres).alias("k"))
    return ranked.where("k = 1 or v <> taken").select(F.when(F.col("k") == 1, F.col("u")).alias("u"), "v", "taken")


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (u, v): component is the least id reachable.

    Self-loops make a component of one vertex; null ends are ignored; repeated edges count once.
    """
    spark = edges.sparkSession
    base, rounds = fresh_path(spark, "components"), []
    given, size, loops = _written(_forest(edges.select("u", "v").where("u is not null and v is not null"), CHUNK, seed=0), f"{base}/given")
    if size <= local_edges:
        labels, _, _ = _written(_forest(given.coalesce(1), local_edges + 1, roots=True), f"{base}/settled")
        delete_path(spark, f"{base}/given")
        return labels.toDF("id", "component")
    peeled = _saved(_peel(given), f"{base}/peeled")
    delete_path(spark, f"{base}/given")
    links = peeled.where("v is not null").select(F.col("taken").alias("u"), "v")
    stars, left, _ = _written(_forest(links, CHUNK, seed=1), f"{base}/round-1")
    while left > local_edges:
        k = len(rounds) + 1
        if k > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        taken = _saved(_take(stars, k), f"{base}/taken-{k}")
        own = taken.where("u is not null").select("u", "taken")
        rounds.append((own, left))
        ends = _lookup(taken.select("v", F.col("taken").alias("a")), own.withColumnsRenamed({"u": "v", "taken": "b"}), "v", left)
        apart = ends.select(F.col("a").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v")
        stars, left, _ = _written(_forest(apart, CHUNK, seed=k + 1), f"{base}/round-{k + 1}")
        delete_path(spark, f"{base}/round-{k}")
    labels, _, _ = _written(_forest(stars.coalesce(1), local_edges + 1, roots=True), f"{base}/settled")
    for k, (own, total) in reversed(list(enumerate(rounds, 1))):
        above = labels.toDF("taken", "label")
        found = _lookup(own, above, "taken", total)
        each = found.select("u", F.coalesce("label", "taken").alias("v"))
        ends = found.where("label is null").select(F.col("taken").alias("u"), F.col("taken").alias("v")).distinct()
        labels, _, _ = _written(each.union(labels).union(ends).distinct(), f"{base}/labels-{k}")
    found = _lookup(peeled.where("u is not null").select("u", "taken"), labels.toDF("taken", "label"), "taken", 2 * size + loops)
    labels, apart, centres = _written(found.select("u", F.coalesce("label", "taken").alias("v")), f"{base}/labels")
    named = labels.groupBy("v").agg(F.min("u").alias("component"))
    return _lookup(labels, named, "v", apart + centres).select(F.col("u").alias("id"), "component")


def component_labels(graph: PropertyGraph, where: Any = None) -> DataFrame:
    """(id, value): the least id of each node's component, for the nodes that a clause brings in.

    Direction is ignored. Under a node clause isolated selected nodes are components of their own;
    otherwise only nodes that touch a selected edge get a value.
    """
    edges = graph.edges_where(where).select("u", "v")
    if graph.clause(where).kind == NODE:
        edges = edges.unionAll(graph.nodes_where(where).select(F.col("id").alias("u"), F.col("id").alias("v")))
    return connected_components(edges).withColumnRenamed("component", "value")


def components(graph: PropertyGraph, output: Any, where: Any = None) -> PropertyGraph:
    """New string node series: the least id in the node's connected component."""
    name = graph.resolve_new(output, NODE)
    return graph.with_node_values(component_labels(graph, where), name, "string")
