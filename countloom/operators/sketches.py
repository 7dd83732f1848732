"""Distinct counts and quantiles that merge: sketches stored by day or month, read for any period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch as a power of two, and values that a quantile sketch keeps a level.
LG, K = 12, 200


def distinct_error(lg: int = LG) -> float:
    """Standard error of an estimate from merged sketches, as a share of the true count."""
    return 1.04 / 2 ** (lg / 2)


def rank_error(k: int = K) -> float:
    """Error of a quantile's rank, as a share of all values, that 99 of 100 estimates keep (fixed values of the sketch)."""
    return 2.296 / k**0.9723


def distinct_sketches(df: DataFrame, column: str, *keys: str, lg: int = LG) -> DataFrame:
    """keys, n_rows, sketch of the distinct values of ``column`` (nulls don't count). Tasks sketch their own rows, so only
    sketches, of some 2 ** lg bytes at most, are shuffled."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg)).alias("sketch"))


def distinct_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """by, n_rows, n_distinct of sketches merged over all other keys."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def refreshed(spark: SparkSession, path: str, facts: DataFrame, column: str, *keys: str, day: str = "day", lg: int = LG) -> DataFrame:
    """The sketches by day and ``keys`` stored at ``path``, with those of days that weren't there yet added from ``facts``.

    Days stored are taken as final: what arrives later for them isn't seen until their sketches are
    deleted. Where nothing is new, nothing is written; the result always reads the stored sketches alone.
    """
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm)
    new = facts
    if there:
        new = facts.join(spark.read.parquet(path).select(day).distinct(), day, "left_anti")
    made = distinct_sketches(new, column, day, *keys, lg=lg)
    if not there or not new.isEmpty():
        made.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def quantile_sketches(df: DataFrame, value: Column, *keys: str, k: int = K) -> DataFrame:
    """keys and sketch of the values; ``value`` may be an array, such as draws, all of whose values count. Arrays are
    unfolded and sketched in the same task, so their length doesn't multiply the shuffle."""
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    own = df.select(*keys, (F.explode(value) if kind == "array" else value).alias("_v")).withColumn("_v", F.col("_v").cast("double"))
    return own.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, *by: str, at: dict[str, float] | None = None) -> DataFrame:
    """by, n_values and a column for each quantile, of sketches merged over all other keys."""
    at = at or {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, F.kll_sketch_get_n_double("_s").alias("n_values"), *(F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(name) for name, p in at.items()))
