"""Selection of what has changed against full runs."""

import shutil

from pyspark.sql import functions as F

from countloom.operators import rollup, select
from countloom.plans import incremental
from countloom.sources import views
from countloom.sources.publish import publish


def full(spark, path):
    return rows(select.best_records(rollup.level_counts(spark.read.parquet(path))))


def rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*names).collect()))


def test_refreshes_equal_full_runs(spark, sf_dir, tmp_path):
    """New rows, changed and removed ones, a new series, a new year and one that goes; and nothing at all."""
    path, state = str(tmp_path / "reports"), str(tmp_path / "state")
    reports = views.reports(spark, sf_dir).cache()
    publish(reports.where("year <= 1997"), path, "year")
    first = incremental.refresh_best(spark, path, state)
    n = reports.where("year <= 1997").select("series", "year").distinct().count()
    assert rows(first.best) == full(spark, path) and first.n_selected == n and max(first.years) == 1997

    again = incremental.refresh_best(spark, path, state)
    assert again.years == [] and again.n_selected == 0 and rows(again.best) == full(spark, path)

    own = spark.read.parquet(path).where("year = 1996").cache()
    a, b, c = [r.series for r in own.select("series").distinct().orderBy("series").limit(3).collect()]
    value = F.when((F.col("series") == a) & (F.col("t_res") == "Week"), F.col("value") + 1000).otherwise(F.col("value"))
    new = own.where(F.col("series") == c).withColumn("series", F.lit("NEW"))
    own.count()
    publish(own.where(F.col("series") != b).withColumn("value", value).unionByName(new), path, "year")
    publish(reports.where("year = 1999"), path, "year")
    second = incremental.refresh_best(spark, path, state)
    assert second.years == [1996, 1999] and second.n_selected == 2 + reports.where("year = 1999").select("series").distinct().count()
    assert rows(second.best) == full(spark, path) and second.best.where(f"year = 1996 and series = '{b}'").isEmpty()

    publish(spark.read.parquet(path).where("year = 1999").repartition(3).cache(), path, "year")  # other files, the same reports
    third = incremental.refresh_best(spark, path, state)
    assert third.years == [1999] and third.n_selected == 0 and rows(third.best) == full(spark, path)

    shutil.rmtree(f"{path}/year=1997")
    fourth = incremental.refresh_best(spark, path, state)
    assert fourth.years == [1997] and fourth.n_selected == 0 and rows(fourth.best) == full(spark, path) and fourth.best.where("year = 1997").isEmpty()


def test_only_changed_folders_are_read(spark, sf_dir, tmp_path):
    path, state = str(tmp_path / "reports"), str(tmp_path / "state")
    publish(views.reports(spark, sf_dir), path, "year")
    incremental.refresh_best(spark, path, state)
    bad = spark.createDataFrame([("x",)], "nothing string")
    shutil.rmtree(f"{path}/year=1998")
    bad.write.parquet(f"{path}/year=1998")  # can't be read as reports
    publish(views.reports(spark, sf_dir).where("year = 1998"), path, "year")
    for year in (1996, 1997):  # unreadable, but unchanged by the file list
        for row in incremental.file_list(spark, path).where(F.col("year") == year).collect():
            import os

            name = row.file.replace("file:", "").replace("//", "/")
            stat = os.stat(name)
            with open(name, "r+b") as file:
                file.write(b"\x00" * 16)
            os.utime(name, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert incremental.refresh_best(spark, path, state).years == [1998]
