"""Relational building blocks that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmetrics.functions.ordered import in_order, part_of, with_row_index, with_running_sum, with_trailing
from plantmetrics.functions.selection import exact_quantile

__all__ = [
    "attach_row", "exact_quantile", "in_ranges", "with_row_index", "with_running_sum", "with_trailing",
]


def attach_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add a one-row frame to every row of ``df`` as a struct column, through a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias(name))
    return df.withColumn(name, packed.scalar())


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The frame written in ``order`` over range partitions, with the partition's number in ``_part``; see ordered.in_order."""
    return in_order(df, order).withColumn("_part", part_of(F.col("_at")).cast("int")).drop("_at")
