"""Parquet output: node and edge tables, and rows with a field specification."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.graph import PropertyGraph
from graphloom.plans.names import EDGE, NODE, SeriesName

#: Letters of the field specification.
FIELD_TYPES = {"b": T.BooleanType(), "i": T.LongType(), "u": T.DecimalType(20, 0), "f": T.DoubleType(), "s": T.StringType()}


def _dump(graph: PropertyGraph, prefix: str, first: Sequence[str], path: str, fields: Sequence[Any] | None, overwrite: bool, where: Any) -> dict[str, Any]:
    table = graph.table_where(prefix, where)
    chosen, warnings = list(first), {}
    for name in [SeriesName.parse(f, prefix) for f in fields] if fields is not None else [SeriesName(prefix, c) for c in table.columns]:
        if name.prefix != prefix or name.name not in table.columns:
            warnings[f"unknown series: {name}"] = warnings.get(f"unknown series: {name}", 0) + 1
        elif name.name not in chosen:
            chosen.append(name.name)
    table.select(*[F.col(f"`{c}`") for c in chosen]).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return {"rows_written": graph.spark.read.parquet(path).count(), "path": path, "warnings": warnings}


def dump_nodes(graph: PropertyGraph, path: str, fields: Sequence[Any] | None = None, overwrite: bool = False, where: Any = None) -> dict[str, Any]:
    """Write ``id`` and the named node series (default all) as a Parquet folder; returns rows_written, path and warnings."""
    return _dump(graph, NODE, ("id",), path, fields, overwrite, where)


def dump_edges(graph: PropertyGraph, path: str, fields: Sequence[Any] | None = None, overwrite: bool = False, where: Any = None) -> dict[str, Any]:
    """Write ``u``, ``v``, ``directed`` and the named edge series (default all) as a Parquet folder."""
    return _dump(graph, EDGE, ("u", "v", "directed"), path, fields, overwrite, where)


def parse_fields(given: str | Sequence[str], delimiter: str = ":") -> T.StructType:
    """A schema from ``"a:i, b:s"`` or ``["a:i", "b:s"]``; types b, i, u, f, s."""
    parts = [p.strip() for p in (given.split(",") if isinstance(given, str) else given)]
    fields: list[T.StructField] = []
    for part in parts:
        name, found, kind = part.rpartition(delimiter)
        name, kind = name.strip(), kind.strip()
        if not found or not name:
            raise ValueError(f"a field is name{delimiter}type: {part!r}")
        if kind not in FIELD_TYPES:
            raise ValueError(f"unknown type {kind!r} of {name!r}; there are {', '.join(FIELD_TYPES)}")
        if name in [f.name for f in fields]:
            raise ValueError(f"repeated field {name!r}")
        fields.append(T.StructField(name, FIELD_TYPES[kind]))
    if not fields:
        raise ValueError("no fields")
    return T.StructType(fields)


class RowWriter:
    """Buffers rows of a field specification and appends a Parquet file per ``batch_rows`` rows.

    A row of the wrong length or with a value of the wrong type is refused. Large data should be
    written from DataFrames; this is for rows that arise on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, fields: str | Sequence[str], delimiter: str = ":", batch_rows: int = 1_000_000):
        self.spark, self.path, self.schema, self.batch_rows = spark, path, parse_fields(fields, delimiter), batch_rows
        self.rows: list[tuple] = []
        self.written, self.closed = 0, False

    def write_row(self, row: Sequence[Any]) -> None:
        """Add a row; ValueError for a wrong length, TypeError for a wrong type."""
        if self.closed:
            raise ValueError("the writer is closed")
        self.rows.append(tuple(self._checked(row)))
        if len(self.rows) >= self.batch_rows:
            self.flush()

    def write_rows(self, rows: Sequence[Sequence[Any]]) -> None:
        for row in rows:
            self.write_row(row)

    def _checked(self, row: Sequence[Any]) -> list[Any]:
        if len(row) != len(self.schema):
            raise ValueError(f"{len(row)} values for {len(self.schema)} fields")
        kinds = {T.BooleanType: bool, T.LongType: int, T.DecimalType: int, T.DoubleType: (float, int), T.StringType: str}
        for value, field in zip(row, self.schema.fields, strict=True):
            wanted = kinds[type(field.dataType)]
            if value is not None and (not isinstance(value, wanted) or isinstance(value, bool) and wanted is not bool):
                raise TypeError(f"{field.name}: {value!r}")
            if isinstance(field.dataType, T.DecimalType) and value is not None and not 0 <= value < 1 << 64:
                raise TypeError(f"{field.name}: {value!r}")
        return [float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else Decimal(v) if isinstance(f.dataType, T.DecimalType) and v is not None else v for v, f in zip(row, self.schema.fields, strict=True)]

    def flush(self) -> None:
        """Write the buffered rows."""
        if self.rows:
            self.spark.createDataFrame(self.rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
            self.written += len(self.rows)
            self.rows = []

    def close(self) -> None:
        self.flush()
        self.closed = True

    def __enter__(self) -> RowWriter:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def write_frame(rows: DataFrame, path: str, fields: str | Sequence[str], delimiter: str = ":") -> None:
    """Write a DataFrame with the columns and types of a field specification."""
    schema = parse_fields(fields, delimiter)
    rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(path)
