"""Tables that are checked while they are written, and partial replacement."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from countloom.sources import publish


def files(root):
    return {str(f.relative_to(root)): (f.stat().st_mtime_ns, f.read_bytes()) for f in Path(root).rglob("*.parquet")}


def rows(spark, path):
    return sorted((r.series, r.value, r.year) for r in spark.read.parquet(path).collect())


def table(spark, data):
    return spark.createDataFrame(data, "series string, value int, year int")


def test_only_the_years_given_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert publish.publish(table(spark, [("a", 1, 2000), ("b", 2, 2000), ("a", 3, 2001), ("a", 4, 2002)]), path, "year") == 4
    before = files(path)
    assert publish.publish(table(spark, [("c", 9, 2001), ("d", 8, 2003)]), path, "year") == 2
    assert rows(spark, path) == [("a", 1, 2000), ("a", 4, 2002), ("b", 2, 2000), ("c", 9, 2001), ("d", 8, 2003)]
    after = files(path)
    for name in before:
        if "2001" not in name:
            assert after[name] == before[name]
    assert not [n for n in os.listdir(path) if n.startswith("_stage")]


def test_a_failing_task_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(table(spark, [("a", 1, 2000)]), path, "year")
    before = files(path)
    bad = table(spark, [("a", 1, 2000), ("boom", 2, 2000), ("c", 1, 2001)]).repartition(3).withColumn("value", F.when(F.col("series") == "boom", F.raise_error(F.lit("task")).cast("int")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="task"):
        publish.publish(bad, path, "year")
    assert files(path) == before and rows(spark, path) == [("a", 1, 2000)] and not [n for n in os.listdir(path) if n.startswith("_stage")]


def test_a_bad_table_isnt_published(spark, tmp_path):
    path = str(tmp_path / "t")
    checks = {"negative": F.col("value") < 0, "repeated": publish.repeats("series", "year"), "unknown": F.col("value").isNull()}
    publish.publish(table(spark, [("a", 1, 2000)]), path, "year", **checks)
    with pytest.raises(publish.CheckFailed, match="negative in 1 rows, repeated in 2 rows") as error:
        publish.publish(table(spark, [("a", -1, 2000), ("b", 2, 2001), ("b", 3, 2001)]), path, "year", **checks)
    assert error.value.broken == {"negative": 1, "repeated": 2} and rows(spark, path) == [("a", 1, 2000)]
    with pytest.raises(publish.CheckFailed):
        publish.checked(table(spark, [("a", 1, 2000), ("a", 2, 2000)]), "t", repeated=publish.repeats("series", "year"))
    assert publish.checked(table(spark, [("a", 1, 2000)]), "t", repeated=publish.repeats("series", "year")).collect() == [("a", 1, 2000)]
    assert publish.checked(table(spark, []), "t", negative=F.col("value") < 0).isEmpty()


@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_replacement_cut_off_is_ended(spark, tmp_path, monkeypatch, at):
    """The job dies after it has moved some of three years: nothing is lost, and the next run ends it."""
    path = str(tmp_path / "t")
    publish.publish(table(spark, [("old", y, y) for y in (1, 2, 3, 4)]), path, "year")
    moved = publish._moved

    def cut(spark, path, stage, parts, emptied):
        p, fs = publish._files(spark, path)
        for part in parts[:at]:
            fs.delete(p(f"{path}/{part}"), True)
            fs.rename(p(f"{stage}/{part}"), p(f"{path}/{part}"))
        raise KeyboardInterrupt

    monkeypatch.setattr(publish, "_moved", cut)
    with pytest.raises(KeyboardInterrupt):
        publish.publish(table(spark, [("new", y, y) for y in (1, 2, 3)]), path, "year")
    monkeypatch.setattr(publish, "_moved", moved)
    assert len(rows(spark, path)) == 4  # staged files aren't read
    assert len(publish.recover(spark, path)) == 1 and publish.recover(spark, path) == []
    assert rows(spark, path) == [("new", 1, 1), ("new", 2, 2), ("new", 3, 3), ("old", 4, 4)]


def test_partitions_that_are_named_go_when_nothing_comes_for_them(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(table(spark, [("a", y, y) for y in (1, 2, 3)]), path, "year")
    publish.publish(table(spark, [("b", 9, 2)]), path, "year", emptied=("year=1", "year=2"))
    assert rows(spark, path) == [("a", 3, 3), ("b", 9, 2)]
    publish.publish(table(spark, []), path, "year", emptied=("year=3",))
    assert rows(spark, path) == [("b", 9, 2)]


def test_several_levels_and_checks_cost_no_job(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, k % 3, ["x", "y"][k % 2]) for k in range(30)], "k int, a int, b string")
    spark.sparkContext.setJobGroup("one", "one")
    assert publish.publish(df, path, "a", "b", low=F.col("k") < 0) == 30
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one")
    spark.sparkContext.setJobGroup("none", "none")
    publish.publish(df.where("a = 1 and b = 'x'").withColumn("k", F.lit(-5)), path, "a", "b")
    assert len(jobs) == 1 and spark.read.parquet(path).where("k = -5").count() == 5 and spark.read.parquet(path).count() == 30
