"""Tasks of a fixed number of rows, and what needs no other shuffle once rows lie by series."""

import datetime
import random

from pyspark.sql import functions as F

from countloom.operators import series
from countloom.sources import shared, views


def weeks(spark):
    rng, rows = random.Random(5), []
    for name in ("a", "b", "c", None):
        for year in range(2001, 2009):
            share = rng.choice([0.0, 0.1, 0.6, 0.97, 1.0])
            for k in range(52):
                start = datetime.date(year - 1, 12, 28) + datetime.timedelta(days=7 * k)
                rows.append((name, year, start if rng.random() < 0.99 else None, k, k if rng.random() < share else None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series string, year int, start_date date, time_seq int, value int").repartition(3)


def test_tasks_do_not_grow_with_the_table(spark, sf_dir, monkeypatch):
    """A task for each 500 lines, whatever the setting for shuffles and the bytes."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    own = views.weekly(spark, sf_dir)
    assert own.rdd.getNumPartitions() == -(-views.table(spark, sf_dir, "lineitem").count() // 500)
    own = own.withColumn("task", F.spark_partition_id())
    assert own.groupBy("series").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] == 1


def test_suppliers_of_one_name_are_one_series(spark, sf_dir, tmp_path):
    for name in ("nation", "region", "lineitem"):
        views.table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    named = F.concat(F.lit("S"), F.col("s_suppkey") % 3)
    views.table(spark, sf_dir, "supplier").withColumns({"s_name": F.when(F.col("s_suppkey") % 3 > 0, named), "s_nationkey": F.lit(1)}).write.parquet(f"{tmp_path}/supplier.parquet")
    want = views.daily(spark, str(tmp_path)).groupBy("series", "region", F.date_sub("day", F.dayofweek("day") - 1).alias("start_date")).agg(F.sum("value").alias("value"))
    got = views.weekly(spark, str(tmp_path)).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.select("series").distinct().count() == 3


def test_patterns_of_rows(spark):
    """Each row has the pattern that its months give, counted one by one."""
    own = weeks(spark)
    months = {}
    for r in own.collect():
        end = r.start_date and r.start_date + datetime.timedelta(days=6)
        month = r.start_date and (1 if end.year != r.start_date.year and end.year == r.year else r.start_date.month)
        months.setdefault((r.series, r.year), {}).setdefault(month, []).append(r.value is not None)
    want = {}
    for key, by_month in months.items():
        whole, none = sum(map(all, by_month.values())), sum(not any(x) for x in by_month.values())
        partial = len(by_month) - whole - none
        want[key] = (sum(map(sum, by_month.values())), whole, partial, none, "dense" if whole >= 6 else "moderate" if whole else "sporadic" if partial else "no_data")
    assert {w[-1] for w in want.values()} == {"dense", "moderate", "sporadic", "no_data"}
    assert {(r.series, r.year): (r.n_weeks, r.n_complete, r.n_partial, r.n_empty, r.pattern) for r in series.data_pattern(own, "series").collect()} == want
    got = series.with_pattern(own, "series")
    assert got.columns == [*own.columns, "pattern"] and got.drop("pattern").exceptAll(own).isEmpty() and got.count() == own.count()
    assert {((r.series, r.year), r.pattern) for r in got.collect()} == {(key, w[-1]) for key, w in want.items()}
    regular, sporadic = series.split_pattern(got)
    assert {r.pattern for r in sporadic.collect()} == {"sporadic"} and regular.count() + sporadic.count() == own.count()


def test_filling_and_patterns_share_a_shuffle(spark):
    own = shared.spread(weeks(spark), 10, "series").withColumn("pred_mean", F.lit(1))
    got = series.with_pattern(series.fill_gaps(own, "series"), "series")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
