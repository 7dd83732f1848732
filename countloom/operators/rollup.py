"""Changes of resolution: days to weeks, weeks to months, places to nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions import calendar as cal
from countloom.functions.sums import lenient_sum, strict_sum, strict_sum_over


def days_to_weeks(df: DataFrame, *keys: str, day: str = "day", value: str = "value") -> DataFrame:
    """Sums of epiweeks, nulls skipped, with the week's dates."""
    out = df.groupBy(*keys, cal.epi_year(day).alias("year"), cal.epi_week(day).alias("week")).agg(lenient_sum(value).alias("value"))
    return out.withColumns({"start_date": cal.epi_week_start("year", "week"), "end_date": cal.epi_week_end("year", "week")})


def quarters_to_years(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Annual sums; null if a quarter is null."""
    return df.groupBy(*keys).agg(strict_sum(value).alias("value"))


def weeks_to_months(df: DataFrame, *keys: str, start: str = "start_date", year: str = "year", value: str = "value", end=None) -> DataFrame:
    """Monthly sums; null if a week is null. A week ends six days after its start
    unless ``end`` says otherwise."""
    last = F.date_add(start, 6) if end is None else end
    return df.groupBy(*keys, year, cal.month_of_week(start, last, year).cast("int").alias("month")).agg(strict_sum(value).alias("value"))


def filled_weeks_to_months(df: DataFrame, *keys: str, pattern: str = "pattern", year: str = "year", month: str = "month", observed: str = "value", filled: str = "filled") -> DataFrame:
    """Months of filled weekly series: in sporadic years the sum of the observed weeks,
    flagged if any was; in others the sum if no week is missing, flagged if a
    fill was needed. Sums are cut to whole numbers."""
    sporadic = F.col(pattern) == "sporadic"
    n, has, seen = F.count(F.lit(1)), F.count(filled), F.count(observed)
    whole = F.when(n == has, F.sum(filled))
    out = df.groupBy(*keys, year, month, pattern).agg(
        F.when(F.first(sporadic), F.when(seen > 0, F.sum(observed))).otherwise(whole).cast("bigint").alias("value"),
        F.when(F.first(sporadic), seen > 0).otherwise((n == has) & (seen < n)).alias("imputed_weekly"),
    )
    return out


def years_to_months(df: DataFrame, *, year: str = "year", value: str = "value") -> DataFrame:
    """Twelve rows a year with a null count and the annual total beside it."""
    first, last = cal.year_bounds(year)
    out = df.withColumn("start_date", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    return out.withColumns(
        {"end_date": F.last_day("start_date"), "month": F.month("start_date"), "annual_total": F.col(value), value: F.lit(None).cast(df.schema[value].dataType)}
    )


def units_to_nation(df: DataFrame) -> DataFrame:
    """Sums of all places by series, period and resolution, nulls skipped; the least
    source stays."""
    keys = ["series", "start_date", "end_date", "year", "t_res"]
    return df.groupBy(*keys).agg(lenient_sum("value").alias("value"), F.min("source").alias("source"))


def level_counts(df: DataFrame) -> DataFrame:
    """series, year, t_res, and for each level its number of periods and strict sum:
    a0_count, a0_sum, ... a2_sum; null where a level has no report.

    One aggregation to periods (whose partial results are combined before the shuffle),
    then one over periods: no distinct count.
    """
    keys = ["series", "year", "t_res"]
    periods = df.groupBy(*keys, "s_res", "start_date", "end_date").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.sum("value").alias("total"))
    out = []
    for k in range(3):
        own = F.col("s_res") == f"Admin{k}"
        rows = F.sum(F.when(own, F.col("n") if k == 0 else F.lit(1)))
        whole = F.sum(F.when(own, F.col("n"))) == F.sum(F.when(own, F.col("known")))
        out += [rows.cast("bigint").alias(f"a{k}_count"), F.when(whole, F.sum(F.when(own, F.col("total")))).alias(f"a{k}_sum")]
    return periods.where(F.col("s_res").isin("Admin0", "Admin1", "Admin2")).groupBy(*keys).agg(*out)


def coverage(df: DataFrame, *extra: str) -> DataFrame:
    """series, year, t_res, n_record (periods), expected (12, 1 or the year's weeks), prop; ``extra`` columns, such as the
    spatial level, belong to the key. A period that several units report counts once: an aggregation to periods, whose
    partial results are combined before the shuffle, comes first."""
    keys = ["series", "year", "t_res", *extra]
    periods = df.groupBy(*keys, "start_date", "end_date").agg(F.lit(1).alias("_one"))
    return share_of_year(periods.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_record")))


def share_of_year(counted: DataFrame) -> DataFrame:
    """Adds expected and prop to numbers of records (year, t_res, n_record)."""
    expected = F.when(F.col("t_res") == "Month", 12).when(F.col("t_res") == "Year", 1).otherwise(cal.weeks_in_year("year"))
    return counted.withColumn("expected", expected.cast("int")).withColumn("prop", F.col("n_record") / F.col("expected"))


def annual_totals(df: DataFrame, *extra: str) -> DataFrame:
    """Sum of each series and year; ``extra`` columns, such as level and resolution, belong to the key."""
    return df.groupBy("series", "year", *extra).agg(lenient_sum("value").alias("annual_total"))


def attach_annual(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Counts cut to whole numbers, and each year's strict total on its rows."""
    out = df.withColumn(value, F.col(value).cast("bigint"))
    return out.withColumn("annual_total", strict_sum_over(value, Window.partitionBy(*keys)))


def source_totals(df: DataFrame, *extra: str) -> DataFrame:
    """First and last date and sum of each source in a series and year."""
    return df.groupBy("series", "year", "source", *extra).agg(F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"), strict_sum("value").alias("total"))


def split_levels(df: DataFrame, *, level: str = "s_res") -> dict[str, DataFrame]:
    """The reports of each spatial level, by its name."""
    return {name: df.where(F.col(level) == name) for name in ("Admin0", "Admin1", "Admin2")}


def tally(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("series").alias("n_series"))
