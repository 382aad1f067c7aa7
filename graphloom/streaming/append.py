"""Edge streams: each micro-batch is ingested into a stored graph; windowed value counts as they arrive."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from graphloom.sources.ingest import ingest_frames
from graphloom.sources.store import GraphStore


def append_stream(store: GraphStore, rows: DataFrame, col_u: str, col_v: str, checkpoint: str, directed: bool = True, metadata: Sequence[str] | None = None) -> DataStreamWriter:
    """A writer that ingests a stream of edge rows into ``store``; call ``start()`` on it.

    The store's manifest keeps the last batch that went in, so a batch that is replayed after a
    failure is ingested once. A batch writes its own rows only.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        store.reload()
        done = store.manifest.get("streams", {})
        if done.get(checkpoint, -1) >= number:
            return
        before = store.graph
        grown, _ = ingest_frames(before, [batch], col_u, col_v, directed, metadata)
        store.save(grown, before, streams=done | {checkpoint: number})

    return rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)


def windowed_counts(rows: DataFrame, time: str, value: Any, width: str, late: str) -> DataFrame:
    """(start, end, value, count) per tumbling window of event time; rows later than ``late`` are dropped."""
    column = value if isinstance(value, Column) else F.col(value)
    counted = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), column.alias("value")).count()
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "count")
