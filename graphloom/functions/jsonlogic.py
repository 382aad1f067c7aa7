"""JSON-logic rules compiled to Spark columns.

The vocabulary is that of the published JSON-logic specification, with ``regex`` added. Values are
booleans, numbers or strings; a comparison of a string with a number reads the string as a number and
is false (``!=``: true) if it is none. Lists may only be literal; ``map``, ``reduce``, ``all``,
``some``, ``none`` and ``merge`` over them are unrolled while compiling.

Where no null can arise once all variables are set, comparisons stay plain, so that Parquet readers
get them as pushed filters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, NUMBER, STRING, NULL, LIST = "bool", "number", "string", "null", "list"


@dataclass(frozen=True)
class Value:
    """A compiled operand. ``items`` holds the members of a literal list, ``literal`` a plain literal.

    sure: not null if no variable is; may_nan: a number that may be no number.
    """

    column: Column | None
    kind: str
    items: tuple[Value, ...] = ()
    literal: Any = None
    sure: bool = False
    may_nan: bool = True


def kind_of(data_type: T.DataType) -> str:
    """The JSON-logic kind of a Spark type."""
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, T.NumericType):
        return NUMBER
    return NULL if isinstance(data_type, T.NullType) else STRING


def variables(rule: Any) -> list[str]:
    """Names of the variables that a rule reads, in order of appearance, once each."""
    found: dict[str, None] = {}

    def walk(part: Any) -> None:
        if isinstance(part, list):
            for x in part:
                walk(x)
        elif isinstance(part, dict):
            for op, args in part.items():
                if op == "var":
                    name = args[0] if isinstance(args, list) and args else args
                    if isinstance(name, str) and name and name not in ("current", "accumulator"):
                        found[name] = None
                    walk(args[1:] if isinstance(args, list) else [])
                else:
                    walk(args)

    walk(rule)
    return list(found)


def truth(value: Value) -> Column:
    """Whether a value counts as true; never null if no variable is."""
    if value.kind == LIST:
        return F.lit(bool(value.items))
    if value.kind == NULL:
        return F.lit(False)
    column = value.column
    if value.kind == NUMBER:
        column = (column != 0) & ~F.isnan(column.cast("double")) if value.may_nan else column != 0
    elif value.kind == STRING:
        column = column != ""
    return _settled(column, value.sure)


def _settled(column: Column, sure: bool) -> Column:
    return column if sure else F.coalesce(column, F.lit(False))


def _number(value: Value) -> Column:
    """As a number, null if it is none."""
    if value.kind == STRING:
        return value.column.try_cast("double")
    if value.kind == BOOL:
        return value.column.cast("double")
    if value.kind == NUMBER:
        return value.column
    return F.lit(None).cast("double")


def _real(value: Value) -> Column:
    return _number(value).cast("double")


def _comparable(value: Value) -> Column:
    """As a number that compares with nothing if it is not a number."""
    column = _real(value)
    return F.when(~F.isnan(column), column)


def _text(value: Value) -> Column:
    if value.kind == STRING:
        return value.column
    if value.kind == NULL:
        return F.lit("")
    if value.kind == LIST:
        return F.concat_ws(",", *map(_text, value.items))
    if value.kind == NUMBER:
        whole = value.column.cast("double")
        return F.when((whole == F.floor(whole)) & (F.abs(whole) < 1e15), whole.cast("long").cast("string")).otherwise(value.column.cast("string"))
    return value.column.cast("string")


def _equal(a: Value, b: Value) -> Column:
    if NULL in (a.kind, b.kind):
        return F.lit(a.kind == b.kind)
    if LIST in (a.kind, b.kind):
        raise ValueError("lists cannot be compared")
    if a.kind != b.kind:
        return F.coalesce(_comparable(a) == _comparable(b), F.lit(False))
    same = a.column == b.column
    if a.kind == NUMBER and a.may_nan and b.may_nan:
        same = same & ~F.isnan(_real(a))
    return _settled(same, a.sure and b.sure)


def _compare(op: str, a: Value, b: Value) -> Column:
    """Spark's not-a-number is greater than all numbers; here it compares with none."""
    if LIST in (a.kind, b.kind):
        raise ValueError("lists cannot be compared")
    plain = a.kind == b.kind and a.kind in (STRING, NUMBER)
    x, y = (a.column, b.column) if plain else (_comparable(a), _comparable(b))
    held = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    greater = b if op in ("<", "<=") else a
    if plain and a.kind == NUMBER and greater.may_nan:
        held = held & ~F.isnan(_real(greater))
    return _settled(held, plain and a.sure and b.sure)


class Compiler:
    """Compiles rules; ``resolve`` gives a variable's column and type."""

    def __init__(self, resolve: Callable[[str], tuple[Column, T.DataType]]):
        self.resolve = resolve
        self.bound: list[dict[str, Value]] = []

    def value(self, rule: Any) -> Value:
        """Compile a rule or literal."""
        if isinstance(rule, dict):
            if len(rule) != 1:
                raise ValueError(f"a rule has one operator: {rule!r}")
            ((op, args),) = rule.items()
            args = args if isinstance(args, list) else [args]
            handler = getattr(self, f"_op_{_NAMES.get(op, op)}", None)
            if handler is None:
                raise ValueError(f"unknown operator {op!r}")
            return handler(args)
        if isinstance(rule, list):
            return Value(None, LIST, tuple(map(self.value, rule)))
        if rule is None:
            return Value(F.lit(None), NULL)
        kind = BOOL if isinstance(rule, bool) else NUMBER if isinstance(rule, (int, float)) else STRING
        return Value(F.lit(rule), kind, literal=rule, sure=True, may_nan=rule != rule)

    def condition(self, rule: Any) -> Column:
        """Whether a rule holds; never null if no variable is."""
        return truth(self.value(rule))

    def _all(self, args: list) -> list[Value]:
        return [self.value(x) for x in args]

    def _op_var(self, args: list) -> Value:
        name = args[0] if args else ""
        if self.bound and (name == "" or name in self.bound[-1]):
            return self.bound[-1][name]
        column, data_type = self.resolve(name)
        kind = kind_of(data_type)
        if len(args) > 1:
            other = self.value(args[1])
            if other.kind == kind:
                column = F.coalesce(column, other.column)
        return Value(column, kind, sure=kind != NULL, may_nan=isinstance(data_type, T.FractionalType))

    def _op_eq(self, args: list) -> Value:
        return Value(_equal(*self._all(args)), BOOL, sure=True)

    def _op_ne(self, args: list) -> Value:
        return Value(~_equal(*self._all(args)), BOOL, sure=True)

    def _op_same(self, args: list) -> Value:
        a, b = self._all(args)
        return Value(_equal(a, b) if a.kind == b.kind else F.lit(False), BOOL, sure=True)

    def _op_differ(self, args: list) -> Value:
        return Value(~self._op_same(args).column, BOOL, sure=True)

    def _chain(self, op: str, args: list) -> Value:
        values = self._all(args)
        return Value(reduce(Column.__and__, [_compare(op, a, b) for a, b in zip(values, values[1:], strict=False)]), BOOL, sure=True)

    def _op_lt(self, args: list) -> Value:
        return self._chain("<", args)

    def _op_le(self, args: list) -> Value:
        return self._chain("<=", args)

    def _op_gt(self, args: list) -> Value:
        return self._chain(">", args)

    def _op_ge(self, args: list) -> Value:
        return self._chain(">=", args)

    def _op_and(self, args: list) -> Value:
        return self._first(args, lambda a, b: F.when(truth(a), b.column).otherwise(a.column), Column.__and__)

    def _op_or(self, args: list) -> Value:
        return self._first(args, lambda a, b: F.when(truth(a), a.column).otherwise(b.column), Column.__or__)

    def _first(self, args: list, choose: Callable, combine: Callable) -> Value:
        values = self._all(args)
        if len({v.kind for v in values}) == 1 and values[0].kind not in (BOOL, LIST):
            return reduce(lambda a, b: Value(choose(a, b), a.kind), values)
        return Value(reduce(combine, map(truth, values)), BOOL, sure=True)

    def _op_not(self, args: list) -> Value:
        return Value(~truth(self.value(args[0])), BOOL, sure=True)

    def _op_truthy(self, args: list) -> Value:
        return Value(truth(self.value(args[0])), BOOL, sure=True)

    def _op_if(self, args: list) -> Value:
        values = self._all(args)
        result = values[-1] if len(values) % 2 else Value(F.lit(None), NULL)
        for k in range(len(values) // 2 * 2 - 2, -1, -2):
            then = values[k + 1]
            if NULL not in (then.kind, result.kind) and then.kind != result.kind:
                then, result = Value(_text(then), STRING), Value(_text(result), STRING)
            kind = then.kind if result.kind == NULL else result.kind
            result = Value(F.when(truth(values[k]), then.column).otherwise(result.column), kind)
        return result

    def _fold(self, args: list, step: Callable[[Column, Column], Column]) -> Value:
        return Value(reduce(step, [_number(x) if x.kind == NUMBER else _real(x) for x in self._all(args)]), NUMBER)

    def _op_plus(self, args: list) -> Value:
        return Value(_real(self.value(args[0])), NUMBER) if len(args) == 1 else self._fold(args, F.try_add)

    def _op_minus(self, args: list) -> Value:
        return self._fold([0, *args] if len(args) == 1 else args, F.try_subtract)

    def _op_times(self, args: list) -> Value:
        return self._fold(args, F.try_multiply)

    def _op_over(self, args: list) -> Value:
        return self._fold(args, F.try_divide)

    def _op_modulo(self, args: list) -> Value:
        return self._fold(args, lambda a, b: F.when(b != 0, a % b))

    def _op_min(self, args: list) -> Value:
        columns = list(map(_real, self._all(args)))
        return Value(F.least(*columns) if len(columns) > 1 else columns[0], NUMBER)

    def _op_max(self, args: list) -> Value:
        columns = list(map(_real, self._all(args)))
        return Value(F.greatest(*columns) if len(columns) > 1 else columns[0], NUMBER)

    def _op_in(self, args: list) -> Value:
        needle, stack = self._all(args)
        if stack.kind == LIST:
            plain = [x.literal for x in stack.items if x.kind == needle.kind]
            if all(x is not None for x in plain):
                return Value(_settled(needle.column.isin(plain), needle.sure) if plain else F.lit(False), BOOL, sure=True)
            return Value(reduce(Column.__or__, [_equal(needle, x) for x in stack.items if x.kind == needle.kind]), BOOL, sure=True)
        if stack.kind != STRING:
            return Value(F.lit(False), BOOL)
        return Value(_settled(F.contains(stack.column, _text(needle)), stack.sure and needle.sure), BOOL, sure=True)

    def _op_cat(self, args: list) -> Value:
        return Value(F.concat(*map(_text, self._all(args))), STRING)

    def _op_substr(self, args: list) -> Value:
        values = self._all(args)
        text, start = _text(values[0]), _number(values[1]).cast("int")
        size = F.length(text)
        first = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(start)
        count = size - first
        if len(values) > 2:
            wanted = _number(values[2]).cast("int")
            count = F.when(wanted < 0, size - first + wanted).otherwise(wanted)
        return Value(F.substring(text, first + 1, F.greatest(count, F.lit(0))), STRING)

    def _op_missing(self, args: list) -> Value:
        return Value(self._absent(args) > 0, BOOL, sure=True)

    def _op_missing_some(self, args: list) -> Value:
        return Value(F.lit(len(args[1])) - self._absent(args[1]) < args[0], BOOL, sure=True)

    def _absent(self, names: list) -> Column:
        names = names[0] if len(names) == 1 and isinstance(names[0], list) else names
        return reduce(Column.__add__, [self.resolve(n)[0].isNull().cast("int") for n in names], F.lit(0))

    def _op_regex(self, args: list) -> Value:
        text, pattern = self._all(args)
        return Value(_settled(F.rlike(_text(text), pattern.column), text.sure and pattern.sure), BOOL, sure=True)

    def _op_log(self, args: list) -> Value:
        return self.value(args[0])

    def _each(self, args: list) -> list[Value]:
        items = self.value(args[0])
        if items.kind != LIST:
            raise ValueError("only literal lists can be gone through")
        found = []
        for item in items.items:
            self.bound.append({"": item})
            found.append(self.value(args[1]))
            self.bound.pop()
        return found

    def _op_map(self, args: list) -> Value:
        return Value(None, LIST, tuple(self._each(args)))

    def _op_all(self, args: list) -> Value:
        found = self._each(args)
        return Value(reduce(Column.__and__, map(truth, found)) if found else F.lit(False), BOOL, sure=True)

    def _op_some(self, args: list) -> Value:
        return Value(reduce(Column.__or__, map(truth, self._each(args)), F.lit(False)), BOOL, sure=True)

    def _op_none(self, args: list) -> Value:
        return Value(~self._op_some(args).column, BOOL, sure=True)

    def _op_merge(self, args: list) -> Value:
        return Value(None, LIST, tuple(x for v in self._all(args) for x in (v.items if v.kind == LIST else (v,))))

    def _op_reduce(self, args: list) -> Value:
        items, total = self.value(args[0]), self.value(args[2] if len(args) > 2 else None)
        if items.kind != LIST:
            raise ValueError("only literal lists can be gone through")
        for item in items.items:
            self.bound.append({"current": item, "accumulator": total, "": item})
            total = self.value(args[1])
            self.bound.pop()
        return total


_NAMES = {
    "==": "eq", "!=": "ne", "===": "same", "!==": "differ", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "!": "not", "!!": "truthy",
    "?:": "if", "+": "plus", "-": "minus", "*": "times", "/": "over", "%": "modulo",
}
