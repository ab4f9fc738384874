"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    The optimizer may inline a projected expression into a lambda, where it would run per element;
    a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pad(values: Column, length: int, fill: Column) -> Column:
    """Cut or fill an array to exactly ``length``."""
    cut = F.slice(values, 1, length)
    return bind(cut, lambda a: F.concat(a, F.array_repeat(fill, F.lit(length) - F.size(a))))


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
