"""Sketches: stated errors, merging, and re-runs that read nothing else."""

import datetime

import pytest
from pyspark.sql import functions as F

from countloom.operators import sketches


def facts(spark, days, n=40_000):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % days).cast("int"))
    return spark.range(n).select(day.alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") % 100 != 7, (F.col("id") * 7919) % 9001).alias("part"))


@pytest.mark.parametrize("lg", [8, 12])
def test_merged_counts_keep_the_stated_error(spark, lg):
    """Any merging of the days' sketches, within four standard errors."""
    df = facts(spark, 60)
    own = sketches.distinct_sketches(df, "part", "day", "source", lg=lg)
    for by in ([], ["source"], ["month"], ["source", "month"]):
        month = F.month("day").alias("month")
        got = {tuple(r[c] for c in by): r for r in sketches.distinct_counts(own.select("*", month), *by).collect()}
        for r in df.select("*", month).groupBy(*by).agg(F.count_distinct("part").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
            one = got[tuple(r[c] for c in by)]
            assert abs(one.n_distinct - r.n) <= 4 * sketches.distinct_error(lg) * r.n + 1 and one.n_rows == r.rows
    assert sketches.distinct_counts(sketches.distinct_sketches(df.limit(0), "part", "day"), "day").isEmpty()


def test_a_re_run_reads_sketches_only(spark, tmp_path):
    path, source = str(tmp_path / "sketches"), str(tmp_path / "facts")
    facts(spark, 20).write.parquet(source)
    first = sketches.refreshed(spark, path, spark.read.parquet(source).where("day < '2020-01-11'"), "part", "source")
    assert first.select("day").distinct().count() == 10
    both = sketches.refreshed(spark, path, spark.read.parquet(source), "part", "source")
    assert both.count() == 40 and both.agg(F.sum("n_rows")).first()[0] == 40_000
    again = sketches.refreshed(spark, path, spark.read.parquet(source), "part", "source")
    assert again.inputFiles() == both.inputFiles() and all("/sketches/" in f for f in again.inputFiles())
    a, b = (sketches.distinct_counts(x, "source").orderBy("source").collect() for x in (again, sketches.distinct_sketches(facts(spark, 20), "part", "day", "source")))
    assert a == b


@pytest.mark.parametrize("k", [50, 200])
def test_pooled_quantiles_keep_the_stated_rank(spark, k):
    """Draws of many months merged by group: the true rank of each estimate is near the one asked for."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda d: (F.col("id") * 37 + d * d * 11) % 10_007)
    df = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 20).alias("series"), (F.col("id") % 2).alias("grp"), draws.alias("draws"))
    own = sketches.quantile_sketches(df, F.col("draws"), "grp", "series", k=k)
    at = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    for by in (["grp"], []):
        for r in sketches.quantiles(own, *by, at=at).collect():
            values = df.where(F.col("grp") == r.grp) if by else df
            values = values.select(F.explode("draws").alias("v"))
            n = values.count()
            assert r.n_values == n
            for name, p in at.items():
                low, high = values.agg(F.avg((F.col("v") < r[name]).cast("double")), F.avg((F.col("v") <= r[name]).cast("double"))).first()
                assert low - sketches.rank_error(k) <= p <= high + sketches.rank_error(k)


def test_values_that_do_not_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), (None, 3.0)], "g string, v double")
    got = {r.g: (r.n_values, r.q50) for r in sketches.quantiles(sketches.quantile_sketches(df, F.col("v"), "g"), "g", at={"q50": 0.5}).collect()}
    assert got == {"a": (1, 1.0), None: (1, 3.0)}
    days = spark.createDataFrame([(datetime.date(2020, 1, 1), None)], "day date, part string")
    assert sketches.distinct_counts(sketches.distinct_sketches(days, "part", "day"), "day").first()[1:] == (1, 0)
