"""Running totals and numbers over many rows, without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.sources.shared import saved


def running_before(df: DataFrame, order: str, weight: str, name: str) -> DataFrame:
    """``name``: the sum of ``weight`` over all rows before, in order of the (distinct)
    values of ``order``. Rows are dealt into ranges; each range is summed by itself, and
    one row a range gives what comes before it."""
    ranges = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    ranges = saved(ranges, "ranges")  # so that a row's range is the same in both uses
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = ranges.groupBy("_range").agg(F.sum(weight).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return own.join(offsets, "_range").withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")
