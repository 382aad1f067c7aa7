"""Series names and selectors that build where-clauses."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

NODE, EDGE = "node", "edge"
RESERVED = frozenset({"node.id", "edge.u", "edge.v", "edge.directed"})


@dataclass(frozen=True, order=True)
class SeriesName:
    """A column of the node or the edge table, written ``prefix.name``; split at the first dot."""

    prefix: str
    name: str

    def __str__(self) -> str:
        return f"{self.prefix}.{self.name}"

    @property
    def reserved(self) -> bool:
        return str(self) in RESERVED

    @classmethod
    def parse(cls, given: Any, default: str | None = None) -> SeriesName:
        """From a name, a selector, or a selector's rule; ``default`` is the prefix of unqualified names."""
        if isinstance(given, SeriesName):
            return given
        if isinstance(given, Selector):
            given = given.rule
        if isinstance(given, dict):
            given = given.get("rule", given).get("var")
        if not isinstance(given, str):
            raise ValueError(f"not a series name: {given!r}")
        prefix, dot, name = given.partition(".")
        if dot and prefix in (NODE, EDGE) and name:
            return cls(prefix, name)
        if default and given and (not dot or prefix not in (NODE, EDGE)):
            return cls(default, given)
        raise ValueError(f"series name needs the prefix node. or edge.: {given!r}")


class Expression:
    """A JSON-logic rule under construction."""

    __hash__ = None  # comparisons build rules

    def __init__(self, rule: Any):
        self.rule = rule

    def _with(self, op: str, other: Any) -> Expression:
        return Expression({op: [self.rule, other.rule if isinstance(other, Expression) else other]})

    def __eq__(self, other: Any) -> Expression:  # type: ignore[override]
        return self._with("==", other)

    def __ne__(self, other: Any) -> Expression:  # type: ignore[override]
        return self._with("!=", other)

    def __lt__(self, other: Any) -> Expression:
        return self._with("<", other)

    def __le__(self, other: Any) -> Expression:
        return self._with("<=", other)

    def __gt__(self, other: Any) -> Expression:
        return self._with(">", other)

    def __ge__(self, other: Any) -> Expression:
        return self._with(">=", other)

    def __add__(self, other: Any) -> Expression:
        return self._with("+", other)

    def __sub__(self, other: Any) -> Expression:
        return self._with("-", other)

    def __mul__(self, other: Any) -> Expression:
        return self._with("*", other)

    def __truediv__(self, other: Any) -> Expression:
        return self._with("/", other)

    def __mod__(self, other: Any) -> Expression:
        return self._with("%", other)

    def __and__(self, other: Any) -> Expression:
        return self._with("and", other)

    def __or__(self, other: Any) -> Expression:
        return self._with("or", other)

    def __invert__(self) -> Expression:
        return Expression({"!": [self.rule]})

    def __bool__(self) -> bool:
        raise TypeError("combine selector expressions with & | ~")

    def isin(self, values: list) -> Expression:
        """Whether the value is one of ``values``."""
        return self._with("in", list(values))

    def contains(self, text: str) -> Expression:
        """Whether the string value contains ``text``."""
        return Expression({"in": [text, self.rule]})

    def rlike(self, pattern: str) -> Expression:
        """Whether the string value has a match of a regular expression."""
        return self._with("regex", pattern)


class Selector(Expression):
    """``graph.edge.weight``: a series as an expression; further attributes extend the name."""

    def __init__(self, name: str):
        super().__init__({"var": name})

    def __getattr__(self, more: str) -> Selector:
        if more.startswith("__"):
            raise AttributeError(more)
        return Selector(f"{self.rule['var']}.{more}")

    def __getitem__(self, more: str) -> Selector:
        return Selector(f"{self.rule['var']}.{more}")
