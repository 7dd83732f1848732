"""Resolution of duplicate reports. Every choice has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.sums import strict_sum
from countloom.operators.intervals import outside

PERIOD = ("series", "start_date", "end_date")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """All rows of keys that occur more than once."""
    key = key or PERIOD
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n > 1").drop("_n")


def conflicting(df: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """Rows of duplicate groups whose value occurs once in the group."""
    key = key or PERIOD
    counted = df.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(*key)), "_same": F.count(F.lit(1)).over(Window.partitionBy(*key, value))})
    return counted.where("_n > 1 and _same = 1").drop("_n", "_same")


def losing_spans(df: DataFrame, *extra: str, place: str = "series") -> DataFrame:
    """Of sources that report duplicates (of a place and period) over the same span of a
    series and year, all but the one with the largest total (ties: the least source)."""
    spans = duplicates(df, place, "start_date", "end_date").groupBy("series", "year", "source", "t_res", *extra).agg(
        F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"), strict_sum("value").alias("total")
    )
    order = Window.partitionBy("series", "year", "first_date", "last_date").orderBy(F.desc_nulls_last("total"), "source", *extra)
    return spans.withColumn("_k", F.row_number().over(order)).where("_k > 1").drop("_k", "total")


def drop_losing_spans(df: DataFrame, t_res: str, *extra: str, place: str = "series") -> DataFrame:
    """Removes every record of a losing source that lies inside its span, for one
    resolution; other resolutions stay."""
    losers = losing_spans(df.where(F.col("t_res") == t_res), *extra, place=place)
    return outside(df, losers, on=("series", "year", "t_res", *extra), null_safe=("source",), low="first_date", high="last_date", width=366)


def drop_smallest(df: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """Removes the single smallest record of every duplicate key (ties: the greatest source)."""
    key = key or PERIOD
    w = Window.partitionBy(*key)
    order = w.orderBy(F.asc_nulls_last(value), F.desc("source"))
    return df.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.row_number().over(order)}).where("_n = 1 or _k > 1").drop("_n", "_k")


def keep_largest(df: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """One record a key: the largest (ties: the least source)."""
    key = key or PERIOD
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(value), "source")
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def keep_first(df: DataFrame, key: tuple[str, ...], order: tuple) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def prefer_known(df: DataFrame, *key: str, value: str = "value", rank: str = "source_rank") -> DataFrame:
    """One record a key: a known value before a null one, then by the source's rank."""
    return keep_first(df, key, (F.col(value).isNull(), F.col(rank), F.desc_nulls_last(value)))


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, if no key repeats; else an error."""
    if not repeated_keys(df, *key).isEmpty():
        raise ValueError(f"keys repeat: {', '.join(key)}")
    return df
