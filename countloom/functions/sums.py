"""Sums and quantiles with the null rules that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strict_sum(column: str | Column) -> Column:
    """Null as soon as one value is null."""
    column = _col(column)
    return F.when(F.count(F.lit(1)) == F.count(column), F.sum(column))


def strict_sum_over(column: str | Column, window: WindowSpec) -> Column:
    column = _col(column)
    return F.when(F.count(F.lit(1)).over(window) == F.count(column).over(window), F.sum(column).over(window))


def lenient_sum(column: str | Column) -> Column:
    """Nulls are skipped; nothing at all sums to 0."""
    return F.coalesce(F.sum(_col(column)), F.lit(0))


def share_of_null(column: str | Column) -> Column:
    return F.avg(_col(column).isNull().cast("int"))


def quantile_type8(values: Column, p: float) -> Column:
    """Quantile of an array: linear between order statistics at (n + 1/3) p + 1/3."""
    own = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(own)
    h = (n + F.lit(1.0 / 3)) * F.lit(p) + F.lit(1.0 / 3)
    low = F.greatest(F.lit(1), F.least(n, F.floor(h).cast("int")))
    high = F.greatest(F.lit(1), F.least(n, low + 1))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), h - F.floor(h)))
    part = F.when(h < 1, 0.0).when(h >= n, 0.0).otherwise(part)
    a, b = F.try_element_at(own, low).cast("double"), F.try_element_at(own, high).cast("double")
    return F.when(n > 0, a + part * (b - a))


def by(*columns: str) -> WindowSpec:
    return Window.partitionBy(*columns)
