"""Set operations on rows and on key tuples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag union of two frames with the same set of columns."""
    if set(left.columns) != set(right.columns):
        raise ValueError("union_all needs identical fields")
    return left.unionByName(right)


def intersect_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples present in both frames (null equals null)."""
    return left.select(*keys).intersect(right.select(*keys))


def except_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples of the left frame that the right frame lacks."""
    return left.select(*keys).subtract(right.select(*keys))
