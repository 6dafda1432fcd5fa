"""Building blocks of column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value in the expression, and computed, once: a lambda variable stands for
    it, which keeps nested functions from growing as powers of two."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column name, computed once a row: a filter on it would be pushed below a projection
    and compute it again there, but isn't pushed below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def present(*parts: Column) -> Column:
    """The parts that are neither null nor empty, as an array."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
