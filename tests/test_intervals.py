"""Rules and spans against a plain loop, and their plans."""

import datetime
import random

from pyspark.sql import functions as F

from countloom.operators import dedup, harmonise, intervals

ROWS = "series string, year int, t_res string, start_date date, end_date date, source string, k int"
RULES = "series string, year int, t_res string, from_date date, to_date date, source_like string"
DAY0 = datetime.date(1999, 6, 1)


def day(k):
    return None if k is None else DAY0 + datetime.timedelta(days=k)


def random_rows(rng, n):
    out = []
    for k in range(n):
        a = rng.choice([None, *range(0, 800, 7)])
        b = None if a is None or rng.random() < 0.05 else a + rng.choice([6, 30])
        out.append((rng.choice(["a", "b", "c", None]), rng.choice([1999, 2000, None]), rng.choice(["Week", "Month"]), day(a), day(b), rng.choice(["main", "maine", "x_1", "xy1", "", None]), k))
    return out


def like(text, pattern):
    import re

    return text is not None and re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text) is not None


def fits(row, rule):
    series, year, t_res, start, end, source, _ = row
    tests = [
        (rule[0], series == rule[0]), (rule[1], year == rule[1]), (rule[2], t_res == rule[2]),
        (rule[3], start is not None and rule[3] is not None and start >= rule[3]), (rule[4], end is not None and rule[4] is not None and end <= rule[4]),
        (rule[5], rule[5] is not None and like(source, rule[5])),
    ]
    return all(given is None or test for given, test in tests)


def nested(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in plan or "CartesianProduct" in plan


def test_rules_of_every_kind_against_a_loop(spark):
    """Any set of fields, wildcards, dates on one side, and rules that fit nothing."""
    rng = random.Random(4)
    rows = random_rows(rng, 600)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    for trial in range(12):
        rules = []
        for _ in range(rng.choice([1, 3, 8])):
            low = rng.choice([None, rng.randrange(-20, 800)])
            high = rng.choice([None, rng.randrange(-20, 900)])
            rule = (rng.choice(["a", "b", "z", None]), rng.choice([1999, 2000, None, None]), rng.choice(["Week", None, None]), day(low), day(high), rng.choice(["main%", "x_1", "%", "%1", "zz%", None, None]))
            if any(v is not None for v in rule):
                rules.append(rule)
        got = {r.k for r in harmonise.exclude(df, spark.createDataFrame(rules, RULES)).collect()}
        assert got == {r[-1] for r in rows if not any(fits(r, rule) for rule in rules)}, rules
    assert harmonise.exclude(df, spark.createDataFrame([(None,) * 6], RULES)).isEmpty()
    assert harmonise.exclude(df, spark.createDataFrame([], RULES)).count() == len(rows)
    assert harmonise.exclude(df.limit(0), spark.createDataFrame([("a", None, None, None, None, "m%")], RULES)).isEmpty()


def test_a_hundred_thousand_rules(spark):
    """Spans of many places and lengths; nothing but equality joins, also where no side can be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rules = spark.range(100_000).select(
            F.when(F.col("id") % 10 != 0, F.concat(F.lit("s"), F.col("id") % 997)).alias("series"), F.lit(None).cast("int").alias("year"), F.when(F.col("id") % 10 == 0, "Month").alias("t_res"),
            F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7919 % 12000).cast("int")).alias("from_date"), F.lit(None).cast("string").alias("source_like"), "id",
        )
        length = F.when(F.col("id") % 1000 == 1, 3000).otherwise(F.col("id") % 40).cast("int")
        rules = rules.withColumn("to_date", F.date_add("from_date", length)).drop("id")
        start = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 31 % 12000).cast("int"))
        df = spark.range(100_000).select(F.concat(F.lit("s"), F.col("id") % 1013).alias("series"), F.year(start).alias("year"), F.when(F.col("id") % 3 == 0, "Month").otherwise("Week").alias("t_res"), start.alias("start_date"), F.date_add(start, 6).alias("end_date"), F.lit("x").alias("source"), "id")
        got = harmonise.exclude(df, rules)
        assert not nested(got)
        spans = {}
        for r in rules.collect():
            spans.setdefault(r.series or "*", []).append((r.from_date.toordinal(), r.to_date.toordinal()))
        import numpy as np

        spans = {k: np.array(v) for k, v in spans.items()}
        kept = set()
        for r in df.collect():
            a, b = r.start_date.toordinal(), r.end_date.toordinal()
            own = [spans[k] for k in ([r.series] if r.series in spans else []) + (["*"] if r.t_res == "Month" else [])]
            if not any(((s[:, 0] <= a) & (b <= s[:, 1])).any() for s in own):
                kept.add(r.id)
        assert {r.id for r in got.select("id").collect()} == kept and 0 < len(kept) < 100_000
        reports = df.withColumn("value", F.lit(1))
        assert not nested(dedup.drop_losing_spans(reports, "Week"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_within_and_outside_part_the_rows(spark):
    rows = random_rows(random.Random(9), 300)
    df = spark.createDataFrame(rows, ROWS)
    spans = [("a", None, day(10), day(100)), (None, "main", day(0), day(400)), ("b", None, day(50), day(40)), ("b", "xy1", None, day(40)), ("c", "main", day(-900), day(9000))]
    table = spark.createDataFrame(spans, "series string, source string, from_date date, to_date date")
    lies = {r[-1] for r in rows if any(r[0] is not None and r[0] == s[0] and r[5] == s[1] and None not in (r[3], r[4], s[2]) and s[2] <= r[3] <= r[4] <= s[3] for s in spans)}
    for width in (None, 1, 10_000):
        args = {"on": ("series",), "null_safe": ("source",), "width": width}
        assert {r.k for r in intervals.outside(df, table, inside=True, **args).collect()} == lies
        assert {r.k for r in intervals.outside(df, table, **args).collect()} == {r[-1] for r in rows} - lies
