"""Where-clauses: what they read, whether they speak of nodes or edges, and their column."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.jsonlogic import Compiler, variables
from graphloom.plans.names import EDGE, NODE, Expression, SeriesName
from graphloom.session import FileSystem

ALL = "all"


@dataclass(frozen=True)
class WhereClause:
    """A predicate over series of one prefix.

    kind is ``node``, ``edge`` or, without variables, ``all``. A row with a null in any variable is
    rejected before the predicate is asked. With ``strict_reference`` a clause of unqualified or
    mixed names, or a constant one, filters nothing; otherwise the former is an error and the latter
    is evaluated.
    """

    rule: Any = True
    predicate: Callable[..., Any] | None = None
    names: tuple[str, ...] = ()
    kind: str = ALL
    pandas: bool = field(default=False)

    @classmethod
    def of(cls, given: Any = None, strict_reference: bool = False) -> WhereClause:
        """From nothing, a clause, an expression, a rule or ``{"rule": rule}``, a JSON file, or (series, callable)."""
        if given is None:
            return cls()
        if isinstance(given, WhereClause):
            return given
        if isinstance(given, Expression):
            return cls.from_rule(given.rule, strict_reference)
        if isinstance(given, Path) or isinstance(given, str) and given.endswith(".json"):
            return cls.from_file(given, strict_reference)
        if isinstance(given, tuple) and len(given) == 2 and callable(given[1]):
            return cls.from_callable(*given, strict_reference=strict_reference)
        if isinstance(given, dict) and set(given) == {"rule"}:
            given = given["rule"]
        return cls.from_rule(given, strict_reference)

    @classmethod
    def from_rule(cls, rule: Any, strict_reference: bool = False) -> WhereClause:
        names = tuple(variables(rule))
        kind = _kind(names, strict_reference)
        if strict_reference and kind == ALL:
            return cls()
        return cls(rule=rule, names=names, kind=kind)

    @classmethod
    def from_file(cls, path: str | Path, strict_reference: bool = False) -> WhereClause:
        """A JSON file that holds ``{"rule": rule}``: of the driver's machine, or of any file system if ``path`` is a URI."""
        if "://" in str(path):
            spark = SparkSession.active()
            held = json.loads(FileSystem(spark, str(path)).read_text(str(path)))
        else:
            held = json.loads(Path(path).read_text())
        if "rule" not in held:
            raise ValueError(f"no rule in {path}")
        return cls.from_rule(held["rule"], strict_reference)

    @classmethod
    def from_callable(cls, series: Sequence[Any], predicate: Callable[..., Any], pandas: bool = False, strict_reference: bool = False) -> WhereClause:
        """A predicate over the listed series: it gets their Columns and returns a Column, or, with ``pandas``, pandas Series."""
        names = tuple(str(SeriesName.parse(s)) for s in series)
        return cls(predicate=predicate, names=names, kind=_kind(names, strict_reference), pandas=pandas)

    def series(self) -> list[SeriesName]:
        """The series read."""
        return [SeriesName.parse(n) for n in self.names]

    def condition(self, schema: T.StructType) -> Column | None:
        """The predicate over a table with ``schema``; None if a series is absent. Null only in rows that it rejects."""
        types = {f.name: f.dataType for f in schema.fields}
        columns = {str(s): s.name for s in self.series()}
        if any(c not in types for c in columns.values()):
            return None
        own = {n: F.col(f"`{c}`") for n, c in columns.items()}
        if self.predicate is not None:
            asked = self.predicate
            if self.pandas:
                asked = F.pandas_udf(lambda *x, f=self.predicate: pd.Series(f(*x)).astype(bool), T.BooleanType())
            held = F.coalesce(asked(*(own[n] for n in self.names)), F.lit(False))
        else:
            held = Compiler(lambda n: (own[n], types[columns[n]]) if n in own else _asked_for(n, types)).condition(self.rule)
        return reduce(Column.__and__, [c.isNotNull() for c in own.values()] + [held])


def _asked_for(name: str, types: dict[str, T.DataType]) -> tuple[Column, T.DataType]:
    """A series that a clause does not read but asks after, as ``missing`` does: its column, or null if there is none."""
    series = SeriesName.parse(name).name
    return (F.col(f"`{series}`"), types[series]) if series in types else (F.lit(None).cast("string"), T.StringType())


def _kind(names: Sequence[str], strict_reference: bool) -> str:
    prefixes = [n.partition(".")[0] if "." in n else "" for n in names]
    if not prefixes:
        return ALL
    if prefixes[0] in (NODE, EDGE) and len(set(prefixes)) == 1:
        return prefixes[0]
    if strict_reference:
        return ALL
    raise ValueError(f"a where-clause needs names of one prefix, node. or edge.: {list(names)}")
