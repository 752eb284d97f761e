"""Putting one-row results side by side with scalar subqueries: no join, no shuffle of the big side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single(one_row: DataFrame) -> Column:
    """A one-row, one-column result as a value for another query."""
    return one_row.scalar()


def beside(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of one-row results next to those of ``left``."""
    for i, other in enumerate(others):
        packed = other.select(F.struct(*other.columns).alias("row")).scalar()
        left = left.select("*", packed.alias(f"_side{i}"))
        left = left.select(*[c for c in left.columns if c != f"_side{i}"], f"_side{i}.*")
    return left
