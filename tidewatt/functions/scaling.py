"""Min-max scaling as SQL expressions.

Spark ML's ``MinMaxScaler`` maps a constant column to 0.5; here it maps to 0.
Values outside the fitted range are not clipped. Expressions are SQL text
because a table scales dozens of columns at once, and one parsed string per
column is much cheaper to build than a tree of column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(low: str, high: str) -> str:
    """Width of the fitted range, 1 for a constant column."""
    return f"if({high} = {low}, 1D, {high} - {low})"


def scale(value: str, low: str, high: str) -> str:
    return f"((cast({value} AS DOUBLE) - {low}) * (1D / {span(low, high)}))"


def unscale(value: str, low: str, high: str) -> str:
    return f"(cast({value} AS DOUBLE) * {span(low, high)} + {low})"


def served_load(value: Column) -> Column:
    """Two decimals, never negative."""
    return F.greatest(F.lit(0.0), F.round(value, 2))


def clamp_load(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)
