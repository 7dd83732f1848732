"""Queries of the calendar (C), roll-up (D) and duplicate (E) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from countloom.functions import calendar as cal
from countloom.operators import dedup, rollup, sketches
from countloom.plans.registry import query
from countloom.sources import views
from countloom.sources.shared import fresh_path, saved
from countloom.sources.views import DAILY, REPORTS, WEEKLY, WEEKLY_SOURCES, sql_epi_start, sql_epi_week, sql_epi_year, sql_week_start, sql_weeks

_MONTH_OF_WEEK = "CAST(CASE WHEN year({e}) <> year({s}) AND year({e}) = {y} THEN 1 ELSE month({s}) END AS INTEGER)"


def sql_month_of_week(start: str, year: str) -> str:
    return _MONTH_OF_WEEK.format(s=start, e=f"({start} + 6)", y=year)


@query(f"""WITH {DAILY} SELECT DISTINCT day, {sql_epi_year('day')} AS epi_year, {sql_epi_week('day')} AS epi_week, {sql_week_start('day')} AS first_day,
  {sql_week_start('day')} + 6 AS last_day, CAST(({sql_epi_week('day')} - 1) % 52 + 1 AS INTEGER) AS folded,
  {sql_month_of_week(sql_week_start('day'), sql_epi_year('day'))} AS month FROM daily""")
def c_epiweeks(spark, sf_dir):
    own = views.daily(spark, sf_dir).select("day").distinct()
    year, week = cal.epi_year("day"), cal.epi_week("day")
    first, last = cal.epi_week_start(year, week), cal.epi_week_end(year, week)
    return own.select("day", year.alias("epi_year"), week.alias("epi_week"), first.alias("first_day"), last.alias("last_day"), cal.folded_week(week).alias("folded"), cal.month_of_week(first, last, year).alias("month"))


def _span(df, column):
    return df.agg(F.min(column), F.max(column)).first()


@query(f"""WITH {WEEKLY}, y AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM weekly)
  SELECT CAST(year AS INTEGER) AS year, {sql_weeks('year')} AS n_weeks FROM y""")
def c_week_counts(spark, sf_dir):
    return cal.week_counts(spark, *_span(views.weekly(spark, sf_dir), "year"))


@query(f"""WITH {WEEKLY}, y AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM weekly),
  w AS (SELECT year, unnest(range(1, {sql_weeks('year')} + 1)) AS week FROM y)
  SELECT {sql_epi_start('year', 'week')} AS start_date, CAST(year AS INTEGER) AS year, CAST(week AS INTEGER) AS week,
         CAST(row_number() OVER (ORDER BY year, week) AS INTEGER) AS time_seq FROM w""")
def c_week_calendar(spark, sf_dir):
    return cal.week_calendar(spark, *_span(views.weekly(spark, sf_dir), "year"))


_PERIODS = f"{DAILY}, periods AS (SELECT DISTINCT region AS series, day AS start_date, day + 6 AS end_date FROM daily)"


def _periods(spark, sf_dir):
    return views.daily(spark, sf_dir).select(F.col("region").alias("series"), F.col("day").alias("start_date"), F.date_add("day", 6).alias("end_date")).distinct()


@query(f"""WITH {_PERIODS}, c AS (SELECT *, {sql_epi_year('start_date')} AS start_epi_year, {sql_epi_week('start_date')} AS start_epi_week,
  {sql_epi_year('end_date')} AS end_epi_year, {sql_epi_week('end_date')} AS end_epi_week FROM periods)
  SELECT *, true AS spans FROM c WHERE start_epi_year <> end_epi_year OR start_epi_week <> end_epi_week""")
def c_span_check(spark, sf_dir):
    return cal.span_check(_periods(spark, sf_dir)).where("spans")


@query(f"""WITH {_PERIODS}, c AS (SELECT *, CASE series WHEN 'AFRICA' THEN start_date WHEN 'ASIA' THEN end_date END AS pick FROM periods)
  SELECT series, CASE WHEN {sql_week_start('start_date')} = {sql_week_start('end_date')} THEN start_date ELSE {sql_week_start('pick')} END AS start_date,
         CASE WHEN {sql_week_start('start_date')} = {sql_week_start('end_date')} THEN end_date ELSE {sql_week_start('pick')} + 6 END AS end_date FROM c""")
def c_reassign_weeks(spark, sf_dir):
    rules = spark.createDataFrame([("AFRICA", "start"), ("ASIA", "end")], "series string, side string")
    return cal.reassign_weeks(_periods(spark, sf_dir), rules)


_ALIGN = f"""{REPORTS}, r AS (SELECT series, unit, s_res, t_res, start_date, end_date, CAST(year(start_date) AS INTEGER) AS year, value FROM reports),
  turns AS (SELECT DISTINCT start_date, end_date, year FROM r WHERE t_res = 'Week' AND ({sql_epi_week('start_date')} = 1 OR {sql_epi_week('start_date')} >= 52)
    AND NOT (month(start_date) = 1 AND year(start_date) = year) AND NOT (month(end_date) = 1 AND year(end_date) = year)
    AND NOT (month(start_date) = 12 AND {sql_epi_week('start_date')} >= 52))"""


@query(f"""WITH {_ALIGN} SELECT r.series, r.unit, r.s_res, r.t_res, r.start_date, r.end_date, CAST(r.year + CASE WHEN turns.year IS NULL THEN 0 ELSE 1 END AS INTEGER) AS year, r.value
  FROM r LEFT JOIN turns USING (start_date, end_date, year)""")
def c_align_year(spark, sf_dir):
    own = saved(views.reports(spark, sf_dir).select("series", "unit", "s_res", "t_res", "start_date", "end_date", F.year("start_date").alias("year"), "value"), "reports")
    return cal.align_year(own)


@query(f"""WITH {REPORTS} SELECT series, unit, s_res, t_res, start_date, end_date, year, 'start in another year' AS issue FROM reports WHERE year(start_date) <> year""")
def c_alignment_issues(spark, sf_dir):
    return cal.alignment_issues(views.reports(spark, sf_dir)).select("series", "unit", "s_res", "t_res", "start_date", "end_date", "year", "issue")


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, last_day(o_orderdate) AS month_end, make_date(year(o_orderdate), 1, 1) AS first_of_year,
  make_date(year(o_orderdate), 12, 31) AS last_of_year, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""")
def c_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "d-M-yyyy")
    own = views.table(spark, sf_dir, "orders").select(cal.parse_day_first(text).alias("day")).distinct()
    first, last = cal.year_bounds(F.year("day"))
    return own.select("day", cal.month_end("day").alias("month_end"), first.alias("first_of_year"), last.alias("last_of_year"), cal.month_start(F.year("day"), F.month("day")).alias("month_start"))


# -- D


@query(f"""WITH {DAILY} SELECT series, source, {sql_epi_year('day')} AS year, {sql_epi_week('day')} AS week, CAST(sum(value) AS BIGINT) AS value,
  {sql_week_start('day')} AS start_date, {sql_week_start('day')} + 6 AS end_date FROM daily GROUP BY ALL""")
def d_days_to_weeks(spark, sf_dir):
    return rollup.days_to_weeks(views.daily(spark, sf_dir), "series", "source")


_QUARTERS = f"""{DAILY}, q AS (SELECT series, source, CAST(year(day) AS INTEGER) AS year, quarter(day) AS quarter, CAST(sum(value) AS BIGINT) AS s FROM daily GROUP BY ALL),
  quarters AS (SELECT series, source, year, quarter, CASE WHEN s % 11 <> 0 THEN s END AS value FROM q)"""


@query(f"WITH {_QUARTERS} SELECT series, year, source, CAST(CASE WHEN count(*) = count(value) THEN sum(value) END AS BIGINT) AS value FROM quarters GROUP BY ALL")
def d_quarters_to_years(spark, sf_dir):
    own = views.daily(spark, sf_dir).groupBy("series", "source", F.year("day").alias("year"), F.quarter("day").alias("quarter")).agg(F.sum("value").alias("s"))
    return rollup.quarters_to_years(own.withColumn("value", F.when(F.col("s") % 11 != 0, F.col("s"))), "series", "year", "source")


@query(f"""WITH {WEEKLY} SELECT series, year, {sql_month_of_week('start_date', 'year')} AS month,
  CAST(CASE WHEN count(*) = count(nullif(value % 13, 0)) THEN sum(value) END AS BIGINT) AS value FROM weekly GROUP BY ALL""")
def d_weeks_to_months(spark, sf_dir):
    own = views.weekly(spark, sf_dir).withColumn("value", F.when(F.col("value") % 13 != 0, F.col("value")))
    return rollup.weeks_to_months(own, "series")


_NATION_YEARS = f"""{DAILY}, totals AS (SELECT nation AS series, CAST(year(day) AS INTEGER) AS year, CAST(sum(value) AS BIGINT) AS value FROM daily GROUP BY ALL)"""


def _nation_years(spark, sf_dir):
    return views.daily(spark, sf_dir).groupBy(F.col("nation").alias("series"), F.year("day").alias("year")).agg(F.sum("value").alias("value"))


@query(f"""WITH {_NATION_YEARS}, m AS (SELECT *, unnest(range(1, 13)) AS month FROM totals)
  SELECT series, year, CAST(NULL AS BIGINT) AS value, make_date(year, month, 1) AS start_date, last_day(make_date(year, month, 1)) AS end_date, CAST(month AS INTEGER) AS month, value AS annual_total FROM m""")
def d_years_to_months(spark, sf_dir):
    return rollup.years_to_months(_nation_years(spark, sf_dir))


@query(f"""WITH {REPORTS} SELECT series, start_date, end_date, year, t_res, CAST(sum(value) AS BIGINT) AS value, min(source) AS source FROM reports WHERE s_res <> 'Admin0' GROUP BY ALL""")
def d_units_to_nation(spark, sf_dir):
    return rollup.units_to_nation(views.reports(spark, sf_dir).where("s_res <> 'Admin0'"))


LEVELS = f"""{REPORTS}, levels AS (SELECT series, year, t_res,
  nullif(count(*) FILTER (s_res = 'Admin0'), 0) AS a0_count, CAST(sum(value) FILTER (s_res = 'Admin0') AS BIGINT) AS a0_sum,
  nullif(count(DISTINCT (start_date, end_date)) FILTER (s_res = 'Admin1'), 0) AS a1_count, CAST(sum(value) FILTER (s_res = 'Admin1') AS BIGINT) AS a1_sum,
  nullif(count(DISTINCT (start_date, end_date)) FILTER (s_res = 'Admin2'), 0) AS a2_count, CAST(sum(value) FILTER (s_res = 'Admin2') AS BIGINT) AS a2_sum
  FROM reports GROUP BY ALL)"""


@query(f"WITH {LEVELS} SELECT * FROM levels")
def d_level_counts(spark, sf_dir):
    return rollup.level_counts(views.reports(spark, sf_dir))


COVERAGE = f"""cover AS (SELECT series, year, t_res, s_res, count(DISTINCT (start_date, end_date)) AS n_record, CAST(CASE t_res WHEN 'Month' THEN 12 WHEN 'Year' THEN 1 ELSE {sql_weeks('year')} END AS INTEGER) AS expected
  FROM reports GROUP BY series, year, t_res, s_res)"""


@query(f"WITH {REPORTS}, {COVERAGE} SELECT *, round(n_record / expected, 6) AS prop FROM cover")
def d_coverage(spark, sf_dir):
    return rollup.coverage(views.reports(spark, sf_dir), "s_res").withColumn("prop", F.round("prop", 6))


@query(f"WITH {REPORTS} SELECT series, year, t_res, s_res, CAST(sum(value) AS BIGINT) AS annual_total FROM reports GROUP BY ALL")
def d_annual_totals(spark, sf_dir):
    return rollup.annual_totals(views.reports(spark, sf_dir), "t_res", "s_res")


@query(f"""WITH {WEEKLY}, v AS (SELECT series, year, start_date, CASE WHEN value % 101 <> 0 THEN value END AS value FROM weekly)
  SELECT *, CAST(CASE WHEN count(*) OVER w = count(value) OVER w THEN sum(value) OVER w END AS BIGINT) AS annual_total FROM v WINDOW w AS (PARTITION BY series, year)""")
def d_attach_annual(spark, sf_dir):
    own = views.weekly(spark, sf_dir).select("series", "year", "start_date", F.when(F.col("value") % 101 != 0, F.col("value")).alias("value"))
    return rollup.attach_annual(own, "series", "year")


@query(f"""WITH {WEEKLY_SOURCES} SELECT series, year, source, min(start_date) AS first_date, max(end_date) AS last_date, CAST(sum(value) AS BIGINT) AS total FROM weekly_sources GROUP BY ALL""")
def d_source_totals(spark, sf_dir):
    return rollup.source_totals(views.weekly_sources(spark, sf_dir))


@query(f"""WITH {DAILY} SELECT source, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n_rows, count(DISTINCT part) AS n_exact, true AS within FROM daily GROUP BY ALL""")
def d_distinct_sketches(spark, sf_dir):
    """Parts reported a source and month, from stored sketches by day, beside the exact number: ``within`` says that they
    differ by no more than five standard errors."""
    own = views.daily(spark, sf_dir).select("source", "day", "part")
    days = sketches.refreshed(spark, fresh_path(spark, "sketches"), own, "part", "source")
    month = F.trunc("day", "month").alias("month")
    near = sketches.distinct_counts(days.select("source", month, "n_rows", "sketch"), "source", "month")
    exact = own.groupBy("source", month).agg(F.count_distinct("part").alias("n_exact"))
    off = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 5 * sketches.distinct_error() * F.col("n_exact") + 1
    return near.join(exact, ["source", "month"]).select("source", "month", "n_rows", "n_exact", off.alias("within"))


@query(f"WITH {REPORTS} SELECT region, t_res, count(*) AS n_rows, count(DISTINCT series) AS n_series FROM reports GROUP BY ALL")
def d_tally(spark, sf_dir):
    return rollup.tally(views.reports(spark, sf_dir), "region", "t_res")


# -- E

_W = "series, region, start_date, source, value, end_date, year, t_res"
_PERIOD = "PARTITION BY series, start_date, end_date"


@query(f"WITH {WEEKLY_SOURCES} SELECT {_W} FROM weekly_sources QUALIFY count(*) OVER ({_PERIOD}) > 1")
def e_duplicates(spark, sf_dir):
    return dedup.duplicates(views.weekly_sources(spark, sf_dir))


@query(f"WITH {WEEKLY_SOURCES} SELECT {_W} FROM weekly_sources QUALIFY count(*) OVER ({_PERIOD}) > 1 AND count(*) OVER ({_PERIOD}, value) = 1")
def e_conflicting(spark, sf_dir):
    return dedup.conflicting(views.weekly_sources(spark, sf_dir))


SPAN_LOSERS = f"""dups AS (SELECT * FROM weekly_sources QUALIFY count(*) OVER ({_PERIOD}) > 1),
  spans AS (SELECT series, year, source, t_res, min(start_date) AS a, max(end_date) AS b, sum(value) AS total FROM dups GROUP BY series, year, source, t_res),
  losers AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY series, year, a, b ORDER BY total DESC, source) > 1)"""


@query(f"""WITH {WEEKLY_SOURCES}, {SPAN_LOSERS} SELECT {_W} FROM weekly_sources w WHERE NOT EXISTS (SELECT 1 FROM losers l WHERE l.series = w.series AND l.year = w.year
  AND l.source = w.source AND l.t_res = w.t_res AND w.start_date >= l.a AND w.end_date <= l.b)""")
def e_drop_losing_spans(spark, sf_dir):
    own = saved(views.weekly_sources(spark, sf_dir), "weekly")  # read for the losers and for the rows
    return dedup.drop_losing_spans(own, "Week")


@query(f"""WITH {WEEKLY_SOURCES} SELECT {_W} FROM weekly_sources
  QUALIFY count(*) OVER ({_PERIOD}) = 1 OR row_number() OVER ({_PERIOD} ORDER BY value, source DESC) > 1""")
def e_drop_smallest(spark, sf_dir):
    return dedup.drop_smallest(views.weekly_sources(spark, sf_dir))


@query(f"WITH {WEEKLY_SOURCES} SELECT {_W} FROM weekly_sources QUALIFY row_number() OVER ({_PERIOD} ORDER BY value DESC, source) = 1")
def e_keep_largest(spark, sf_dir):
    return dedup.keep_largest(views.weekly_sources(spark, sf_dir))


@query(f"WITH {WEEKLY_SOURCES} SELECT {_W} FROM weekly_sources QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY start_date, source) = 1")
def e_keep_first(spark, sf_dir):
    return dedup.keep_first(views.weekly_sources(spark, sf_dir), ("series", "year"), ("start_date", "source"))


_KNOWN = "known AS (SELECT series, start_date, source, CASE WHEN value % 3 <> 0 THEN value END AS value, CASE source WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS source_rank FROM weekly_sources)"


@query(f"WITH {WEEKLY_SOURCES}, {_KNOWN} SELECT series, start_date, source, value, CAST(source_rank AS INTEGER) AS source_rank FROM known QUALIFY row_number() OVER (PARTITION BY series, start_date ORDER BY value IS NULL, source_rank) = 1")
def e_prefer_known(spark, sf_dir):
    rank = F.when(F.col("source") == "O", 1).when(F.col("source") == "F", 2).otherwise(3)
    own = views.weekly_sources(spark, sf_dir).select("series", "start_date", "source", F.when(F.col("value") % 3 != 0, F.col("value")).alias("value"), rank.alias("source_rank"))
    return dedup.prefer_known(own, "series", "start_date")


@query(f"WITH {WEEKLY_SOURCES} SELECT series, start_date, count(*) AS n FROM weekly_sources GROUP BY ALL HAVING count(*) > 1")
def e_repeated_keys(spark, sf_dir):
    return dedup.repeated_keys(views.weekly_sources(spark, sf_dir), "series", "start_date")
