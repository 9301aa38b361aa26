"""Ordered sets of strings, as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered_distinct(values: Column, most: int | None = None) -> Column:
    """Trimmed, without blanks, first seen first; at most ``most`` of them."""
    out = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
    return out if most is None else F.slice(out, 1, most)


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(ordered_distinct(values))


def difference(a: Column, b: Column) -> Column:
    """Sorted values of ``a`` that ``b`` lacks; repeated ones stay repeated."""
    return F.array_sort(F.filter(a, lambda x: ~F.array_contains(b, x)))


def ordered_difference(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def jaccard(a: Column, b: Column) -> Column:
    """Shared values over all values of two arrays; 0 if both are empty."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / whole)
