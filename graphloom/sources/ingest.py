"""Edge lists from Parquet, CSV or any DataFrame into a graph."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.formatting import label
from graphloom.plans.graph import PropertyGraph, endpoints
from graphloom.plans.names import RESERVED
from graphloom.session import materialise

_RESERVED_EDGE = {n.partition(".")[2] for n in RESERVED if n.startswith("edge.")}


def series_column(field: T.StructField) -> Column | None:
    """A column as one of the four series types, or None if its type has no counterpart."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.BooleanType, T.LongType, T.DoubleType, T.StringType)):
        return column
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    if isinstance(kind, T.FloatType):
        return column.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{field.name}`)")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return column.cast("string")
    return None


def prepare_edges(rows: DataFrame, col_u: str, col_v: str, directed: bool, metadata: Sequence[str] | None, warnings: Counter) -> DataFrame:
    """(u, v, directed, series...) from input rows, null ends kept; counts columns of unsupported types."""
    for column in (col_u, col_v):
        if column not in rows.columns:
            raise ValueError(f"no such column: {column}")
    wanted = [c for c in rows.columns if c not in (col_u, col_v)] if metadata is None else [c for c in metadata if c in rows.columns]
    if reserved := sorted(set(wanted if metadata is None else metadata) & _RESERVED_EDGE):
        raise ValueError(f"reserved names among the metadata: {reserved}")
    chosen = []
    for name in wanted:
        column = series_column(rows.schema[name])
        if column is None:
            warnings[f"Unsupported column type: {name} {rows.schema[name].dataType.simpleString()}"] += 1
        else:
            chosen.append(column.alias(name))
    ends = [label(F.col(f"`{c}`"), rows.schema[c].dataType.simpleString()).alias(end) for c, end in ((col_u, "u"), (col_v, "v"))]
    return rows.select(*ends, F.lit(directed).alias("directed"), *chosen)


def align(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent series are null, a series that is long here and double there becomes double."""
    kinds: dict[str, T.DataType] = {}
    for table in tables:
        for f in table.schema.fields:
            known = kinds.setdefault(f.name, f.dataType)
            if known != f.dataType:
                if {type(known), type(f.dataType)} == {T.LongType, T.DoubleType}:
                    kinds[f.name] = T.DoubleType()
                else:
                    raise ValueError(f"series {f.name} is {known.simpleString()} here and {f.dataType.simpleString()} there")
    return reduce(DataFrame.unionAll, [t.select(*[(F.col(f"`{n}`") if n in t.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]) for t in tables])


def ingest_frames(graph: PropertyGraph, frames: Sequence[DataFrame], col_u: str, col_v: str, directed: bool = True, metadata: Sequence[str] | None = None) -> tuple[PropertyGraph, dict[str, int]]:
    """Append edges from DataFrames and the ends that are new as nodes.

    Returns the graph and {num_edges_ingested, num_nodes_ingested}. Rows with a null end are skipped
    and counted in the warnings. The new edges are written once, so counts and later queries agree.
    """
    warnings = Counter(graph.warnings)
    read = align([prepare_edges(f, col_u, col_v, directed, metadata, warnings) for f in frames])
    read = materialise(read, "ingest")
    whole = read.where("u is not null and v is not null")
    ingested, skipped = read.agg(F.count_if(F.expr("u is not null and v is not null")), F.count_if(F.expr("u is null or v is null"))).first()
    if skipped:
        warnings["row skipped: no u or v"] += skipped
    fresh = materialise(endpoints(whole).join(graph.nodes.select("id"), "id", "left_anti"), "ingest-nodes")
    grown = graph.replace(nodes=align([graph.nodes, fresh]), edges=align([graph.edges, whole]), warnings=warnings, growth=(graph, {"nodes": fresh, "edges": whole}))
    return grown, {"num_edges_ingested": ingested, "num_nodes_ingested": fresh.count()}


def _files(spark: SparkSession, path: str, recursive: bool, suffix: str) -> list[str]:
    """Data files below a path, through the file system of its URI."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, recursive)
    names = []
    while found.hasNext():
        file = found.next().getPath()
        if not file.getName().startswith(("_", ".")) and file.getName().endswith(suffix):
            names.append(file.toString())
    return sorted(names)


def _merged(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by schema, as few groups as their types allow: footers are read by a job, which is halved where types disagree."""
    try:
        schema = spark.read.option("mergeSchema", len(files) > 1).parquet(*files).schema
    except Exception as error:
        if len(files) == 1 or "MERGE_SCHEMA" not in str(error):
            raise
        found: dict[str, list[str]] = {}
        for half in (files[: len(files) // 2], files[len(files) // 2 :]):
            for key, own in _merged(spark, half).items():
                found.setdefault(key, []).extend(own)
        return found
    return {schema.json(): files}


def read_parquet(spark: SparkSession, path: str, recursive: bool = True) -> list[DataFrame]:
    """The Parquet files below a path, as one DataFrame per schema, since files may disagree on types."""
    files = _files(spark, path, recursive, ".parquet") or [path]
    return [spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*own) for s, own in _merged(spark, files).items()]


def ingest_parquet_edges(graph: PropertyGraph, path: str, col_u: str, col_v: str, directed: bool = True, metadata: Sequence[str] | None = None, recursive: bool = True) -> tuple[PropertyGraph, dict[str, int]]:
    """Append the edges of Parquet files below ``path``; metadata defaults to all other columns."""
    return ingest_frames(graph, read_parquet(graph.spark, path, recursive), col_u, col_v, directed, metadata)


def ingest_csv_edges(graph: PropertyGraph, path: str, col_u: str, col_v: str, directed: bool = True, metadata: Sequence[str] | None = None, schema: str | T.StructType | None = None) -> tuple[PropertyGraph, dict[str, int]]:
    """Append the edges of CSV files with a header; types are inferred unless ``schema`` is given."""
    reader = graph.spark.read.option("header", True)
    rows = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return ingest_frames(graph, [rows], col_u, col_v, directed, metadata)


def csv_to_parquet(spark: SparkSession, source: str, target: str, partitions: int | None = None) -> None:
    """Convert CSV files with a header to a Parquet folder."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(source)
    (rows.repartition(partitions) if partitions else rows).write.mode("overwrite").parquet(target)
