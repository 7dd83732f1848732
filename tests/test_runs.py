"""Runs over stretches of long series, against a plain scan."""

import datetime
import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from countloom.operators import series

SCHEMA = "series string, unit int, day date, t int, value double, batch int"


def made(seed, n_series=6, n=400):
    rng, rows = random.Random(seed), []
    for s in range(n_series):
        name = None if s == 0 else f"s{s}"
        t, known = rng.randrange(-200, 200), True
        for _ in range(rng.choice([1, 2, n])):
            t += rng.choice([1, 1, 1, 30])
            known = known if rng.random() < 0.97 else not known
            rows.append((name, s % 2 or None, datetime.date(2000, 1, 1) + datetime.timedelta(days=11 * t), t, 1.5 if known else None, t // 90))
    rng.shuffle(rows)
    return rows


def plain(rows, reset):
    out = {}
    for key, own in groupby(sorted(rows, key=lambda r: (repr(r[:2]), r[3])), lambda r: r[:2]):
        run_id, last, run = 0, None, []
        for row in [*own, None]:
            state = None if row is None else (row[4] is None, row[5] if reset else 0)
            if state != last:
                for r in run:
                    out[r[:4]] = (last[0], run_id, len(run))
                run_id, run, last = run_id + 1, [], state
            if row is not None:
                run.append(row)
    return out


@pytest.mark.parametrize("order", ["t", "day"])
@pytest.mark.parametrize("reset", [None, "batch"])
def test_against_a_plain_scan(spark, order, reset):
    """Runs that begin before a stretch, fill it and end after it; null keys; stretches of one row."""
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        want = plain(rows, reset)
        got = series.with_runs(df, "series", "unit", order=order, reset=reset)
        assert got.columns == [*df.columns, "is_null", "run_id", "run_len"]
        assert {(r.series, r.unit, r.day, r.t): (r.is_null, r.run_id, r.run_len) for r in got.collect()} == want
        one = {}
        for (name, unit, day, t), (is_null, run_id, run_len) in want.items():
            at = day if order == "day" else t
            low, high = one.get((name, unit, run_id, is_null, run_len), (at, at))
            one[name, unit, run_id, is_null, run_len] = (min(low, at), max(high, at))
        got = series.runs(df, "series", "unit", order=order, reset=reset, nulls_only=False).collect()
        assert {(r.series, r.unit, r.run_id, r.is_null, r.run_len): (r["first"], r["last"]) for r in got} == one and len(got) == len(one)
        nulls = series.runs(df, "series", "unit", order=order, reset=reset).collect()
        assert {r.run_id for r in nulls} == {k[2] for k in one if k[3]} and all(r.is_null for r in nulls)


def test_any_stretch_gives_the_same(spark):
    rows = made(3, 3, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, None)
    for stretch in (F.lit(0), F.col("t"), F.floor(F.col("t") / 7)):
        got = series.with_runs(df, "series", "unit", order="t", stretch=stretch).collect()
        assert {(r.series, r.unit, r.day, r.t): (r.is_null, r.run_id, r.run_len) for r in got} == want


def test_one_endless_series_is_spread(spark):
    """Every window over cells is by series and stretch, so a task holds some stretches of 52, not all 200,000 rows."""
    df = spark.range(200_000).select(F.lit("only").alias("series"), F.col("id").cast("int").alias("t"), F.when(F.col("id") % 1000 < 990, F.col("id")).alias("value"))
    got = series.with_runs(df, "series", order="t")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[[^\n]*?\], \[([^\]]*)\]", plan)
    assert windows and all(w.startswith(("_key", "_whole")) for w in windows)
    sizes = got.groupBy(F.floor(F.col("t") / series.STRETCH)).count().agg(F.max("count")).first()[0]
    assert sizes == series.STRETCH
    assert got.where("is_null").agg(F.count_distinct("run_id"), F.min("run_len"), F.max("run_len")).first()[:] == (200, 10, 10)
    assert got.where("not is_null").agg(F.count_distinct("run_id"), F.max("run_len")).first()[:] == (200, 990)
    assert series.runs(df, "series", order="t").count() == 200


def test_calendar_leaves_out_what_nobody_reads(spark):
    """The first year is looked up only for time_seq."""
    df = spark.createDataFrame([("a", datetime.date(2019, 12, 29), 2020, 3)], "series string, start_date date, year int, value int")
    weeks = series.complete_weeks(df, "series")
    assert weeks.agg(F.count(F.lit(1)), F.min("time_seq"), F.max("time_seq")).first()[:] == (53, 1, 53)
    assert "subquery" not in weeks.select("series", "value")._jdf.queryExecution().optimizedPlan().toString().lower()
