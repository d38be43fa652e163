"""Column building blocks for the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that mentions an outer expression computes it again for every
    element; bound as a lambda variable it is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(n: Column) -> Column:
    """0 … n-1, empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")))


def words(text: Column) -> Column:
    """White-space separated words of a text; empty for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+"), lambda w: w != "")
