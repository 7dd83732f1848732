"""Epidemiological weeks and other calendar arithmetic, as column expressions.

An epiweek begins on Sunday and belongs to the year that holds its Wednesday. All
functions are closed forms over Spark's date functions: they stay inside code
generation and need no lookup table.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def week_start(day: str | Column) -> Column:
    """The Sunday on or before ``day``."""
    day = _col(day)
    return F.date_sub(day, F.dayofweek(day) - 1)


def epi_year(day: str | Column) -> Column:
    return F.year(F.date_add(week_start(day), 3))


def epi_week(day: str | Column) -> Column:
    return F.floor((F.dayofyear(F.date_add(week_start(day), 3)) + 6) / 7).cast("int")


def epi_week_start(year: str | Column, week: str | Column) -> Column:
    """First day of a week: 4 January always lies in week 1."""
    fourth = F.make_date(_col(year), F.lit(1), F.lit(4))
    return F.date_add(week_start(fourth), ((_col(week) - 1) * 7).cast("int"))


def epi_week_end(year: str | Column, week: str | Column) -> Column:
    return F.date_add(epi_week_start(year, week), 6)


def weeks_in_year(year: str | Column) -> Column:
    year = _col(year)
    return (F.datediff(epi_week_start(year + 1, F.lit(1)), epi_week_start(year, F.lit(1))) / 7).cast("int")


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_end(day: str | Column) -> Column:
    return F.last_day(_col(day))


def year_bounds(year: str | Column) -> tuple[Column, Column]:
    return F.make_date(_col(year), F.lit(1), F.lit(1)), F.make_date(_col(year), F.lit(12), F.lit(31))


def month_of_week(start: str | Column, end: str | Column, year: str | Column) -> Column:
    """Month that a week counts for: its start's, but January where it crosses into ``year``."""
    start, end, year = _col(start), _col(end), _col(year)
    return F.when((F.year(end) != F.year(start)) & (F.year(end) == year), F.lit(1)).otherwise(F.month(start))


def folded_week(week: str | Column) -> Column:
    """Weeks 1 to 52; week 53 counts as week 1."""
    return (F.pmod(_col(week) - 1, F.lit(52)) + 1).cast("int")


def parse_day_first(text: str | Column) -> Column:
    """Dates written day-month-year; null where the text is no date."""
    return F.to_date(F.try_to_timestamp(_col(text), F.lit("d-M-yyyy")))


def week_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """start_date, year, week, time_seq for every epiweek of the years. The rows of a
    year come from its own expression, and ``time_seq`` from a date difference, so no
    window runs over the whole calendar."""
    first = date(first_year, 1, 4)
    first -= timedelta(days=(first.weekday() + 1) % 7)
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    weeks = years.select("year", F.explode(F.sequence(F.lit(1), weeks_in_year("year"))).alias("week"))
    start = epi_week_start("year", "week")
    return weeks.select(start.alias("start_date"), "year", "week", (F.datediff(start, F.lit(first)) / 7 + 1).cast("int").alias("time_seq"))


def week_counts(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """year, n_weeks."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.select("year", weeks_in_year("year").alias("n_weeks"))


def span_check(df: DataFrame, *, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Adds the epi year and week of both ends and ``spans`` (they differ)."""
    out = df.withColumns({"start_epi_year": epi_year(start), "start_epi_week": epi_week(start), "end_epi_year": epi_year(end), "end_epi_week": epi_week(end)})
    return out.withColumn("spans", (F.col("start_epi_year") != F.col("end_epi_year")) | (F.col("start_epi_week") != F.col("end_epi_week")))


def reassign_weeks(df: DataFrame, rules: DataFrame, *, series: str = "series", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Moves weeks that span two epiweeks to the week of their start or of their end,
    as ``rules`` (series, side: start or end) says, and rebuilds both dates. A series
    without a rule gets null dates; weeks that fit stay."""
    checked = span_check(df, start=start, end=end).join(rules.select(F.col("series").alias(series), "side"), series, "left")
    side = F.when(F.col("side") == "start", F.struct(F.col("start_epi_year").alias("y"), F.col("start_epi_week").alias("w")))
    side = side.when(F.col("side") == "end", F.struct(F.col("end_epi_year").alias("y"), F.col("end_epi_week").alias("w")))
    moved = checked.withColumn("_to", side)
    first = F.when(F.col("spans"), epi_week_start(F.col("_to.y"), F.col("_to.w"))).otherwise(F.col(start))
    last = F.when(F.col("spans"), epi_week_end(F.col("_to.y"), F.col("_to.w"))).otherwise(F.col(end))
    return moved.withColumns({start: first, end: last}).select(*df.columns)


def align_year(df: DataFrame, *, start: str = "start_date", end: str = "end_date", year: str = "year", t_res: str = "t_res") -> DataFrame:
    """Adds one to the year of weeks at the turn of the year that count for the next one.

    The distinct (start, end, year) of weekly rows in epiweek 1 or from 52 on need it
    unless one of their ends says otherwise; all rows with such a triple are moved,
    of whatever resolution.
    """
    s, e, y = F.col(start), F.col(end), F.col(year)
    week = epi_week(s)
    keeps = ((F.month(s) == 1) & (F.year(s) == y)) | ((F.month(e) == 1) & (F.year(e) == y)) | ((F.month(s) == 12) & (week >= 52))
    turns = df.where((F.col(t_res) == "Week") & ((week == 1) | (week >= 52)) & ~keeps).select(start, end, year).distinct().withColumn("_moves", F.lit(True))
    return df.join(turns, [start, end, year], "left").withColumn(year, F.when(F.col("_moves"), y + 1).otherwise(y)).select(*df.columns)


def alignment_issues(df: DataFrame, *, start: str = "start_date", end: str = "end_date", year: str = "year", t_res: str = "t_res") -> DataFrame:
    """Rows whose dates don't fit their resolution, with ``issue``."""
    s, e = F.col(start), F.col(end)
    first, last = year_bounds(F.year(s))
    issue = (
        F.when((F.col(t_res) == "Year") & ((s != first) | (e != last)), "annual dates")
        .when((F.col(t_res) == "Month") & ((F.dayofmonth(s) != 1) | (e != F.last_day(s))), "monthly dates")
        .when(F.year(s) != F.col(year), "start in another year")
    )
    return df.withColumn("issue", issue).where(F.col("issue").isNotNull())
