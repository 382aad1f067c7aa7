"""Generators of synthetic values, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of generated names.
FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gia", "Hugo", "Ida", "Jon", "Kim", "Leo", "Mia", "Noa", "Ole", "Pia")
LAST = ("Abel", "Berg", "Chen", "Diaz", "Evans", "Frank", "Garcia", "Hill", "Ito", "Jones", "Khan", "Lopez", "Moore", "Novak", "Olsen", "Park")
HOSTS = ("example.com", "example.net", "example.org")
LIMIT = 10_000_000


def _whole(limit: int, seed: int | None) -> Column:
    """A whole number from 0 to ``limit`` inclusive."""
    return F.floor((F.rand(seed) if seed is not None else F.rand()) * (limit + 1)).cast("long")


def _pick(values: tuple[str, ...], seed: int | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_whole(len(values) - 1, seed) + 1).cast("int"))


def _next(seed: int | None, k: int) -> int | None:
    return None if seed is None else seed + k


def _letters(n: int, seed: int | None) -> Column:
    return F.concat(*[F.char(_whole(25, _next(seed, k)) + 97) for k in range(n)])


GENERATORS: dict[str, Callable[[int | None], Column]] = {
    "uuid4": lambda seed: F.uuid() if seed is None else F.uuid(F.lit(seed)),
    "integer": lambda seed: _whole(LIMIT, seed),
    "double": lambda seed: (F.rand(seed) if seed is not None else F.rand()) * LIMIT,
    "percentage": lambda seed: (F.rand(seed) if seed is not None else F.rand()) * 100,
    "int_percentage": lambda seed: _whole(100, seed),
    "two_char_string": lambda seed: _letters(2, seed),
    "bool": lambda seed: (F.rand(seed) if seed is not None else F.rand()) < 0.5,
    "name": lambda seed: F.concat_ws(" ", _pick(FIRST, seed), _pick(LAST, _next(seed, 1))),
    "email": lambda seed: F.concat(F.lower(_pick(FIRST, seed)), F.lit("."), F.lower(_pick(LAST, _next(seed, 1))), F.lit("@"), _pick(HOSTS, _next(seed, 2))),
    "username": lambda seed: F.concat(F.lower(_pick(FIRST, seed)), _whole(9999, _next(seed, 1)).cast("string")),
}


def generator(name: str, seed: int | None = None) -> Column:
    """A named generator as a column; ValueError lists the names there are."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; there are {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](seed)
