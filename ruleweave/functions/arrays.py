"""Set helpers on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_col


def overlaps(a: Column | str, b: Column | str) -> Column:
    """True when two arrays share an element; null elements never match."""
    a, b = as_col(a), as_col(b)
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def sorted_union(a: Column | str, b: Column | str) -> Column:
    """Ordered union of two sets."""
    return F.array_sort(F.array_union(as_col(a), as_col(b)))


def sorted_insert(a: Column | str, element: Column) -> Column:
    """Ordered set with one more element."""
    return sorted_union(a, F.array(element))
