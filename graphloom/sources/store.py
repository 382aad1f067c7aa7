"""Graphs at a path: Parquet folders and numbered manifests that name the current ones.

A table is a list of parts, each a folder with its own schema. An ingest adds a part with the new rows
alone; a change of another kind writes the table that changed as one new part. Then the next manifest is
created, which fails if another writer made it first, so no change is lost, a reader sees the old or the
new graph, and nothing is read while it is written over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.graph import PropertyGraph
from graphloom.session import FileSystem, delete_path
from graphloom.sources.ingest import align

MANIFEST, TABLES = "_manifest-{:08d}.json", ("nodes", "edges")


class ConcurrentChange(RuntimeError):
    """Another writer changed the graph since it was read."""


class GraphStore:
    """A graph kept at a path. ``graph`` is the current one; ``update`` applies an operation and keeps its result."""

    def __init__(self, spark: SparkSession, path: str, overwrite: bool = False, create: bool = True, strict_reference: bool = False):
        """Open the graph at ``path``; create an empty one if there is none, or if ``overwrite``."""
        self.spark, self.path, self.strict_reference = spark, str(path).rstrip("/"), strict_reference
        self.files = FileSystem(spark, self.path)
        if overwrite:
            delete_path(spark, self.path)
        self.manifest: dict[str, Any] = {"version": -1}
        if not self.reload():
            if not create:
                raise FileNotFoundError(f"no graph at {path}")
            self.save(PropertyGraph.empty(spark))

    def _versions(self) -> list[int]:
        return sorted(int(n[10:18]) for n in self.files.names(self.path) if n.startswith("_manifest-") and n.endswith(".json") and len(n) == 23)

    def reload(self) -> bool:
        """Read the newest manifest; false if there is none."""
        versions = self._versions()
        if versions and versions[-1] != self.manifest["version"]:
            self.manifest = json.loads(self.files.read_text(f"{self.path}/{MANIFEST.format(versions[-1])}"))
        return bool(versions)

    def _table(self, parts: list[dict[str, Any]]) -> DataFrame:
        """All parts of a table; those of one schema and the same names are read together."""
        alike: dict[str, list[str]] = {}
        for part in parts:
            alike.setdefault(json.dumps([part["schema"], part.get("names", {})]), []).append(f"{self.path}/{part['folder']}")
        read = []
        for key, folders in alike.items():
            schema, names = json.loads(key)
            held = self.spark.read.schema(T.StructType.fromJson(schema)).parquet(*folders)
            read.append(held.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in held.columns]))
        return align(read)

    @property
    def graph(self) -> PropertyGraph:
        """The current graph."""
        return PropertyGraph(**{name: self._table(self.manifest[name]) for name in TABLES}, path=self.path, strict_reference=self.strict_reference)

    def _write(self, table: DataFrame, name: str, version: int) -> dict[str, Any]:
        folder = f"v{version}-{uuid.uuid4().hex[:8]}/{name}"
        table.write.parquet(f"{self.path}/{folder}")
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema.fields])
        return {"folder": folder, "schema": json.loads(nullable.json())}

    @staticmethod
    def _relabel(part: dict[str, Any], change: dict[str, str | None]) -> dict[str, Any]:
        """A part whose files stay, with other names of its columns or without some of them."""
        fields, names = part["schema"]["fields"], part.get("names", {})
        now = {f["name"]: change.get(names.get(f["name"], f["name"]), names.get(f["name"], f["name"])) for f in fields}
        kept = {"fields": [f for f in fields if now[f["name"]] is not None]}
        return part | {"schema": part["schema"] | kept, "names": {k: v for k, v in now.items() if v not in (None, k)}}

    def _commit(self, manifest: dict[str, Any]) -> None:
        if not self.files.create_text(f"{self.path}/{MANIFEST.format(manifest['version'])}", json.dumps(manifest)):
            raise ConcurrentChange(f"{self.path} was changed by another writer after version {self.manifest['version']}")
        self.manifest = manifest

    def save(self, graph: PropertyGraph, before: PropertyGraph | None = None, **notes: Any) -> PropertyGraph:
        """Make ``graph`` the current one.

        A table that is still that of ``before`` is not written again; of one that ``before`` grew to by an ingest only the
        new rows are written, and of one whose series were renamed or dropped nothing. Notes are kept in the manifest, in the same step, and stay until they are replaced.
        """
        version = self.manifest["version"] + 1
        manifest: dict[str, Any] = {**self.manifest, **notes, "version": version}
        grown = graph.growth[1] if before is not None and graph.growth and graph.growth[0] is before else {}
        base, prefix, change = graph.relabelled or (None, None, {})
        for name in TABLES:
            if before is not None and base is before and name == f"{prefix}s":
                manifest[name] = [self._relabel(part, change) for part in self.manifest[name]]
            elif name in grown:
                manifest[name] = [*self.manifest[name], self._write(grown[name], name, version)]
            elif before is None or getattr(graph, name) is not getattr(before, name):
                manifest[name] = [self._write(getattr(graph, name), name, version)]
        self._commit(manifest)
        current = self.graph
        current.warnings.update(graph.warnings)
        return current

    def update(self, operation: Callable[..., Any], *args: Any, **options: Any) -> Any:
        """Apply ``operation(graph, ...)`` to the newest graph and keep the one it returns, alone or first in a tuple; returns the rest."""
        self.reload()
        before = self.graph
        made = operation(before, *args, **options)
        graph, rest = made if isinstance(made, tuple) else (made, None)
        self.save(graph, before)
        return rest

    def good(self) -> bool:
        """Whether manifest and tables are there and the reserved series have their types."""
        present = all(self.files.exists(f"{self.path}/{part['folder']}") for t in TABLES for part in self.manifest[t])
        return present and self.graph.good()

    def compact(self, most: int = 1) -> list[str]:
        """Rewrite tables of more than ``most`` parts as one part; returns their names."""
        self.reload()
        many, version = [t for t in TABLES if len(self.manifest[t]) > most], self.manifest["version"] + 1
        if many:
            self._commit({**self.manifest, "version": version} | {t: [self._write(self._table(self.manifest[t]), t, version)] for t in many})
        return many

    def vacuum(self) -> list[str]:
        """Remove folders and manifests that the newest manifest does not need; returns the folders. Not while others write."""
        self.reload()
        kept = {part["folder"] for t in TABLES for part in self.manifest[t]}
        for version in self._versions():
            if version < self.manifest["version"]:
                delete_path(self.spark, f"{self.path}/{MANIFEST.format(version)}")
        gone = []
        for version in self.files.names(self.path):
            held = [f"{version}/{t}" for t in self.files.names(f"{self.path}/{version}")] if version.startswith("v") else []
            for folder in (f for f in held if f not in kept):
                delete_path(self.spark, f"{self.path}/{folder}")
                gone.append(folder)
            if held and not kept.intersection(held):
                delete_path(self.spark, f"{self.path}/{version}")
        return gone


def copy_graph(spark: SparkSession, source: str, target: str) -> None:
    """Copy a stored graph; FileNotFoundError if there is none."""
    files = FileSystem(spark, source)
    if not files.exists(source):
        raise FileNotFoundError(source)
    files.copy(source, target)


def remove_graph(spark: SparkSession, path: str) -> bool:
    """Remove a stored graph; false if there was none."""
    return delete_path(spark, path)
