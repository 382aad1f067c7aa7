"""Text of vertex labels that come as numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shortest(value: float) -> str:
    """Shortest round-trip text of a float, fixed or scientific, whichever is shorter, fixed if equal.

    Scientific exponents have a sign and two digits at least: 1.0 -> 1, 100000.0 -> 1e+05,
    0.001 -> 0.001, 1.5e-7 -> 1.5e-07.
    """
    if not np.isfinite(value):
        return str(float(value))
    scientific = np.format_float_scientific(value, trim="-", exp_digits=2)
    fixed = np.format_float_positional(value, trim="-")
    return scientific if len(scientific) < len(fixed) else fixed


@F.pandas_udf(T.StringType())
def _shortest(values: pd.Series) -> pd.Series:
    return values.map(shortest, na_action="ignore").astype(object)


def shortest_double(column: Column) -> Column:
    """``shortest`` of a float or double column. Spark's own cast writes 1.0 and 1.0E20 and is not always the shortest.

    Integral numbers with at most four zeros at the end are the digits of a long, which no exponent shortens; Python sees
    the others alone.
    """
    value = column.cast("double")
    plain = (F.abs(value) < 1e15) & (value == F.floor(value)) & (value % 100_000 != 0)
    return F.when(F.isnan(column), "nan").when(plain, value.cast("long").cast("string")).otherwise(_shortest(F.when(~plain, column)))


def label(column: Column, data_type: str) -> Column:
    """Text of a vertex label of any type; null stays null."""
    if data_type in ("double", "float"):
        return F.when(column.isNotNull(), shortest_double(column))
    return column.cast("string")
