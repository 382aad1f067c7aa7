"""Exact-size, seeded, placement-independent samples.

A row's sampling key is the md5 of the seed and the row's content (a node's id, all columns of an
edge), so samples repeat whatever the partitioning. The k rows with the least keys are the sample.
The k-th least key is found by a top-k for small k, and for large k, from the written keys, by histograms
of leading digits that narrow down to one bucket, so no full sort is needed to mark the sampled rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import HIT, PropertyGraph
from graphloom.plans.names import EDGE, NODE
from graphloom.session import materialise

#: Up to so many keys are found by a top-k.
DIRECT, DIGITS = 100_000, 3
_KEY = "__sampling_key"


def sampling_key(graph: PropertyGraph, prefix: str, seed: int) -> Column:
    """md5 of seed and content of a row of the node or edge table; each value with its length, so no two contents are alike."""
    columns = ["id"] if prefix == NODE else graph.edges.columns
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.md5(F.concat_ws(",", F.lit(str(seed)), *parts).cast("binary"))


def kth_key(keys: DataFrame, k: int, prefix: str = "") -> str | None:
    """The k-th least value of the column ``_KEY`` (hexadecimal digits); None if there are at most k rows."""
    held = keys.where(F.col(_KEY).startswith(prefix)) if prefix else keys
    if k <= DIRECT:
        top = held.orderBy(_KEY).limit(k).agg(F.count("*").alias("n"), F.max(_KEY).alias("last")).first()
        return top["last"] if top["n"] == k else None
    width = len(prefix) + DIGITS
    for row in held.groupBy(F.substring(_KEY, 1, width).alias("d")).count().orderBy("d").collect():
        if k <= row["count"]:
            return row["d"] if width >= 32 else kth_key(keys, k, row["d"])
        k -= row["count"]
    return None


def _cut(keys: DataFrame, k: int) -> tuple[str, int, int] | None:
    """(last key, rows with it that are taken, rows with it in all) of the k least keys; None if there are at most k rows."""
    if k <= DIRECT:
        top = keys.orderBy(_KEY).limit(k + 1).agg(F.array_sort(F.collect_list(_KEY)).alias("t"))
        last, following = F.get("t", F.lit(k - 1)), F.get("t", F.lit(k))
        row = top.select(last.alias("last"), following.alias("following"), F.size(F.filter("t", lambda x: x < last)).alias("below")).first()
        if row["following"] is None:
            return None
        equal = keys.where(F.col(_KEY) == row["last"]).count() if row["following"] == row["last"] else k - row["below"]
        return row["last"], k - row["below"], equal
    keys = materialise(keys, "sampling-keys")
    last = kth_key(keys, k)
    if last is None:
        return None
    below, equal = keys.agg(F.count_if(F.col(_KEY) < last), F.count_if(F.col(_KEY) == last)).first()
    return last, k - below, equal


def mark_sample(graph: PropertyGraph, prefix: str, k: int, seed: int | None = None, where: Any = None) -> DataFrame:
    """The whole table with ``HIT`` true for exactly min(k, n) of the n rows under a clause.

    The table is read once for the keys and once to mark it. Rows with the last key are equal, so if only some of them are
    taken, one of them is repeated, marked or not.
    """
    keyed = graph.mark(prefix, where).withColumn(_KEY, sampling_key(graph, prefix, seed or 0))
    if k <= 0:
        return keyed.withColumn(HIT, F.lit(False)).drop(_KEY)
    cut = _cut(keyed.where(HIT).select(_KEY), k)
    if cut is None:
        return keyed.drop(_KEY)
    last, taken, equal = cut
    if taken == equal:
        return keyed.withColumn(HIT, F.col(HIT) & (F.col(_KEY) <= last)).drop(_KEY)
    own = (F.col(_KEY) == last) & F.col(HIT)
    apart = keyed.where(~own).withColumn(HIT, F.col(HIT) & (F.col(_KEY) < last))
    places = graph.spark.range(equal).select((F.col("id") < taken).alias("__taken"), F.lit(last).alias("__last"))
    repeated = places.join(F.broadcast(keyed.where(own).limit(1)), F.col("__last") == F.col(_KEY))
    return apart.unionByName(repeated.withColumn(HIT, F.col("__taken")).drop("__taken", "__last")).drop(_KEY)


def _sampled(graph: PropertyGraph, prefix: str, output: Any, k: int, seed: int | None, where: Any) -> PropertyGraph:
    name = graph.resolve_new(output, prefix)
    marked = mark_sample(graph, prefix, k, seed, where)
    return graph.with_table(prefix, marked.withColumn(name.name, F.when(F.col(HIT), F.lit(True))).drop(HIT))


def sample_edges(graph: PropertyGraph, output: Any, k: int, seed: int | None = None, where: Any = None) -> PropertyGraph:
    """New boolean edge series: true for k random edges under a clause, null for all others; no seed is seed 0."""
    return _sampled(graph, EDGE, output, k, seed, where)


def sample_nodes(graph: PropertyGraph, output: Any, k: int, seed: int | None = None, where: Any = None) -> PropertyGraph:
    """New boolean node series: true for k random nodes under a clause, null for all others."""
    return _sampled(graph, NODE, output, k, seed, where)


def _select_sample(graph: PropertyGraph, prefix: str, k: int, series: Sequence[Any] | None, seed: int | None, where: Any) -> DataFrame:
    names = [graph.resolve(s, prefix) for s in (series if series is not None else graph.table(prefix).columns)]
    keyed = graph.table_where(prefix, where).withColumn(_KEY, sampling_key(graph, prefix, seed or 0))
    if k > DIRECT:
        keyed = mark_sample(graph, prefix, k, seed, where).where(HIT)
    else:
        keyed = keyed.orderBy(_KEY).limit(k)
    return keyed.select(*[F.col(f"`{n.name}`").alias(str(n)) for n in names])


def select_sample_edges(graph: PropertyGraph, k: int, series: Sequence[Any] | None = None, seed: int | None = None, where: Any = None) -> DataFrame:
    """k random edges under a clause, with the named series (default all)."""
    return _select_sample(graph, EDGE, k, series, seed, where)


def select_sample_nodes(graph: PropertyGraph, k: int, series: Sequence[Any] | None = None, seed: int | None = None, where: Any = None) -> DataFrame:
    """k random nodes under a clause, with the named series (default all)."""
    return _select_sample(graph, NODE, k, series, seed, where)
