"""Queries of the jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from countloom.operators import rollup, series
from countloom.plans import jobs
from countloom.plans.queries_select import _FIRST, _SPECIAL, SCALED, _first
from countloom.plans.queries_series import COMPLETE, ESTIMATES, N_DRAWS, RUNS, SQL_Y
from countloom.plans.queries_time import SPAN_LOSERS, sql_month_of_week
from countloom.plans.registry import query
from countloom.sources import views
from countloom.sources.shared import saved
from countloom.sources.views import DAILY, EXTERNAL, WEEKLY, WEEKLY_SOURCES, sql_epi_week, sql_epi_year, sql_week_start, sql_weeks

_W1 = f"""{SCALED}, ex AS (SELECT r.series, r.year, r.t_res, r.start_date, r.end_date, CAST(sum(r.value) AS BIGINT) AS value FROM reports r
    JOIN best b ON r.series = b.series AND r.year = b.year AND r.t_res = b.t_res AND replace(r.s_res, 'Admin', 'a') = b.level
    WHERE NOT (b.category = 'Annual > sub-annual' AND b.complete AND b.t_res = 'Year') GROUP BY ALL),
  w1 AS (SELECT s.series, s.year, f.t_res, s.start_date, s.value, s.scaled, true AS scaled_to_annual FROM scaled s JOIN fallback f ON f.series = s.series AND f.year = s.year
    UNION ALL SELECT series, year, t_res, start_date, value, value, false FROM ex)"""


def _selected(spark, sf_dir):
    return jobs.select_and_scale(views.reports(spark, sf_dir), special=_SPECIAL)


@query(f"WITH {_W1} SELECT * FROM w1")
def w1_select_and_scale(spark, sf_dir):
    return _selected(spark, sf_dir)


_W2 = f"""{_W1}, {EXTERNAL}, {_FIRST}, nt AS (SELECT n_name AS series, n_nationkey AS k FROM nation),
  rep AS (SELECT series, year, t_res, start_date, CASE t_res WHEN 'Week' THEN start_date + 6 WHEN 'Month' THEN last_day(start_date) ELSE make_date(year, 12, 31) END AS end_date, scaled AS value,
    CASE WHEN month(start_date) > 6 THEN 'ad_hoc_data' ELSE 'main' END AS cat FROM w1 WHERE (year + length(series)) % 3 <> 0),
  known AS (SELECT r.* FROM rep r LEFT JOIN first f USING (series) WHERE f.first_year IS NULL OR r.year >= f.first_year
    UNION ALL SELECT series, y, 'Year', make_date(y, 1, 1), make_date(y, 12, 31), 0, 'first_year' FROM (SELECT series, CAST(unnest(range(1993, first_year)) AS INTEGER) AS y FROM first)),
  cnt AS (SELECT series, year, t_res, count(*) AS n_record FROM known GROUP BY ALL), tot AS (SELECT series, year, CAST(sum(value) AS BIGINT) AS t FROM known GROUP BY ALL),
  src AS (SELECT * FROM (SELECT DISTINCT series, year, cat, t_res FROM known) QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY CASE cat WHEN 'ad_hoc_data' THEN 0 WHEN 'main' THEN 1 ELSE 2 END, cat, t_res) = 1),
  own AS (SELECT series, year, t, cat, t_res, n_record, n_record / CASE t_res WHEN 'Month' THEN 12 WHEN 'Year' THEN 1 ELSE {sql_weeks('year')} END AS prop FROM tot JOIN src USING (series, year) JOIN cnt USING (series, year, t_res)),
  grid AS (SELECT s.series, CAST(y.year AS INTEGER) AS year, t, cat, t_res, n_record, prop, t IS NULL AND k % 3 = 0 AS z FROM (SELECT DISTINCT series FROM own) s JOIN nt USING (series) CROSS JOIN (SELECT unnest(range(1993, 2003)) AS year) y
    LEFT JOIN own ON own.series = s.series AND own.year = y.year),
  tested AS (SELECT series, year, t_res, n_record, prop, z, CASE WHEN z THEN 0 ELSE t END AS t, CASE WHEN z THEN 'assumed_zero' ELSE coalesce(cat, 'No_data') END AS src,
    CASE WHEN z THEN 'No_modelling_required' WHEN prop IS NULL THEN 'No_data' WHEN t_res = 'Year' AND t = 0 THEN 'No_modelling_required' WHEN t_res = 'Year' AND prop = 1 THEN 'Annual_disaggregation'
      WHEN prop = 1 THEN 'No_modelling_required' WHEN prop < 1 THEN 'Sub_annual_imputation' END AS cm FROM grid),
  cal AS (SELECT g.*, CAST(trunc(estimate * (avg(t) OVER w / nullif(avg(estimate) OVER w, 0))) AS BIGINT) AS c FROM tested g LEFT JOIN external e ON e.series = g.series AND e.year = g.year WINDOW w AS (PARTITION BY g.series)),
  cald AS (SELECT series, year, t_res, n_record, prop, coalesce(t, c) AS v, CASE WHEN t IS NOT NULL THEN src WHEN c IS NOT NULL THEN 'calibrated' ELSE 'No_data' END AS src,
    CASE WHEN t IS NOT NULL THEN cm WHEN c <> 0 THEN 'Annual_disaggregation' WHEN c = 0 THEN 'No_modelling_required' ELSE 'No_data' END AS cm FROM cal),
  live AS (SELECT * FROM cald WHERE series NOT IN (SELECT series FROM cald GROUP BY series HAVING sum(v) = 0 AND count(v) = count(*))),
  near AS (SELECT g.series, g.year, o.v FROM live g JOIN live o ON o.series = g.series AND o.v IS NOT NULL WHERE g.v IS NULL QUALIFY row_number() OVER (PARTITION BY g.series, g.year ORDER BY abs(o.year - g.year), o.year) <= 10),
  med AS (SELECT series, year, CAST(trunc(median(v)) AS BIGINT) AS m FROM near GROUP BY ALL),
  coverage AS (SELECT s.series, s.year, coalesce(v, m) AS annual_total, CASE WHEN v IS NULL AND m IS NOT NULL THEN 'Median_from_neighbors' ELSE src END AS data_source,
    CASE WHEN v IS NULL AND m <> 0 THEN 'Annual_disaggregation' WHEN v IS NULL AND m = 0 THEN 'No_modelling_required' ELSE cm END AS cat_model, (v IS NULL AND m IS NOT NULL) OR src IN ('assumed_zero', 'calibrated') AS made, t_res, n_record, prop
    FROM live s LEFT JOIN med ON med.series = s.series AND med.year = s.year)"""


def _totals(spark, sf_dir):
    own = _selected(spark, sf_dir).where((F.col("year") + F.length("series")) % 3 != 0)  # some years are missing
    end = F.when(F.col("t_res") == "Week", F.date_add("start_date", 6)).when(F.col("t_res") == "Month", F.last_day("start_date")).otherwise(F.make_date("year", F.lit(12), F.lit(31)))
    cat = F.when(F.month("start_date") > 6, "ad_hoc_data").otherwise("main")
    own = own.select("series", "year", "t_res", "start_date", end.alias("end_date"), F.col("scaled").alias("value"), cat.alias("cat"))
    listed = views.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("series"))
    return jobs.annual_totals(own, views.external(spark, sf_dir), _first(spark, sf_dir), listed, 1993, 2002)


@query(f"""WITH {_W2} SELECT series, year, annual_total, data_source, cat_model, CASE WHEN made THEN 'Year' ELSE t_res END AS t_res, CASE WHEN made THEN 1 ELSE n_record END AS n_record,
  round(CASE WHEN made THEN 1 ELSE prop END, 6) AS prop FROM coverage""")
def w2_annual_totals(spark, sf_dir):
    return _totals(spark, sf_dir)[0].withColumn("prop", F.round("prop", 6))


@query(f"""WITH {_W2} SELECT series, year, t_res, start_date, end_date, CAST(value AS BIGINT) AS value, cat FROM known WHERE series IN (SELECT series FROM coverage)
  UNION ALL SELECT series, year, 'Year', make_date(year, 1, 1), make_date(year, 12, 31), annual_total, 'assumed' FROM coverage WHERE made""")
def w2_records(spark, sf_dir):
    """Selected reports with an annual record for each assumed total."""
    return _totals(spark, sf_dir)[1]


@query(f"WITH {WEEKLY_SOURCES}, {SPAN_LOSERS}, kept AS (SELECT * FROM weekly_sources w WHERE NOT EXISTS (SELECT 1 FROM losers l WHERE l.series = w.series AND l.year = w.year AND l.source = w.source AND l.t_res = w.t_res AND w.start_date >= l.a AND w.end_date <= l.b)) SELECT series, start_date, source, value FROM kept QUALIFY row_number() OVER (PARTITION BY series, start_date, end_date ORDER BY value DESC, source) = 1")
def w0_clean_weekly(spark, sf_dir):
    return jobs.clean_weekly(views.weekly_sources(spark, sf_dir)).select("series", "start_date", "source", "value")


_CLEAN = f"""{WEEKLY_SOURCES}, allowed AS (SELECT *, series AS full_name FROM weekly_sources WHERE NOT (year = 1996 AND source LIKE 'G%')), {SPAN_LOSERS.replace('weekly_sources', 'allowed')},
  kept AS (SELECT * FROM allowed w WHERE NOT EXISTS (SELECT 1 FROM losers l WHERE l.series = w.series AND l.year = w.year AND l.source = w.source AND l.t_res = w.t_res AND w.start_date >= l.a AND w.end_date <= l.b))"""


@query(f"WITH {_CLEAN} SELECT full_name, year, start_date, t_res, source, value FROM kept QUALIFY row_number() OVER (PARTITION BY full_name, t_res, start_date, end_date ORDER BY value DESC, source) = 1")
def w0_clean_reports(spark, sf_dir):
    """Rules, years at the turn, sources that lose over a span, then the largest report."""
    reports = saved(views.weekly_sources(spark, sf_dir).withColumn("full_name", F.col("series")), "sources")
    rules = spark.createDataFrame([(None, 1996, None, None, None, "G%")], "series string, year int, t_res string, from_date date, to_date date, source_like string")
    return jobs.clean_reports(reports, rules).select("full_name", "year", "start_date", "t_res", "source", "value")


def _sources(spark, sf_dir):
    """Weekly, monthly and annual counts of a third of the nations each; half of the
    first third reports every other month too."""
    daily = views.daily(spark, sf_dir).select(F.col("nation").alias("series"), "nation_key", "region", "day", "value")
    k = F.col("nation_key")
    weekly = rollup.days_to_weeks(daily.where(k % 3 == 0), "series", "region", "nation_key")
    weekly = weekly.select("series", "region", "start_date", "year", F.when((k + F.col("week")) % 6 != 0, F.col("value")).alias("value"))
    month = daily.where((k % 3 == 1) | ((k % 6 == 0) & (F.month("day") % 2 == 0))).groupBy("series", "nation_key", "region", F.year("day").alias("year"), F.month("day").alias("month"))
    monthly = month.agg(F.sum("value").alias("value")).withColumn("value", F.when((k + F.col("month")) % 5 != 0, F.col("value"))).drop("nation_key")
    annual = daily.where(k % 3 == 2).groupBy("series", "region", F.year("day").alias("year")).agg(F.sum("value").alias("value"))
    return weekly, monthly, annual


_W3_WEEKLY = f"""{DAILY}, wk0 AS (SELECT nation AS series, nation_key AS k, region, {sql_week_start('day')} AS start_date, {sql_epi_year('day')} AS year, {sql_epi_week('day')} AS week, CAST(sum(value) AS BIGINT) AS v
    FROM daily WHERE nation_key % 3 = 0 GROUP BY ALL), weekly AS (SELECT series, region, start_date, year, CASE WHEN (k + week) % 6 <> 0 THEN v END AS value FROM wk0)"""


def _sql_filled(own: str, name: str, most: int) -> str:
    """Gaps of the table filled by the floor of the series' mean."""
    return f"""{name}_p AS (SELECT *, CAST(floor(avg(value) OVER (PARTITION BY series)) AS BIGINT) AS p, CASE WHEN (value IS NULL) IS NOT DISTINCT FROM lag(value IS NULL) OVER (PARTITION BY series, year ORDER BY time_seq) THEN 0 ELSE 1 END AS b FROM {own}),
  {name}_r AS (SELECT *, sum(b) OVER (PARTITION BY series, year ORDER BY time_seq) AS r FROM {name}_p),
  {name} AS (SELECT *, value IS NULL AND count(*) OVER (PARTITION BY series, year, r) <= {most} AND p IS NOT NULL AS gap, CASE WHEN value IS NULL AND count(*) OVER (PARTITION BY series, year, r) <= {most} THEN p ELSE value END AS filled FROM {name}_r)"""


_W3 = f"""{_W3_WEEKLY}{COMPLETE[len(WEEKLY):]}, {_sql_filled('complete', 'fw', 4)},
  mo AS (SELECT *, {sql_month_of_week('start_date', 'year')} AS month FROM fw), mm AS (SELECT series, year, month, count(*) AS n, count(coalesce(value, filled)) AS seen FROM mo GROUP BY ALL),
  pattern AS (SELECT series, year, count(*) FILTER (seen = n) = 0 AND count(*) FILTER (seen > 0 AND seen < n) > 0 AS sporadic FROM mm GROUP BY ALL),
  wm AS (SELECT mo.series, region, mo.year, CAST(month AS INTEGER) AS month, CAST(CASE WHEN sporadic THEN sum(value) WHEN count(*) = count(filled) THEN sum(filled) END AS BIGINT) AS value,
    CASE WHEN sporadic THEN count(value) > 0 ELSE count(*) = count(filled) AND count(value) < count(*) END AS iw FROM mo JOIN pattern USING (series, year) GROUP BY mo.series, region, mo.year, month, sporadic),
  rm AS (SELECT nation AS series, region, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(CASE WHEN (nation_key + month(day)) % 5 <> 0 THEN sum(value) END AS BIGINT) AS value FROM daily
    WHERE nation_key % 3 = 1 OR (nation_key % 6 = 0 AND month(day) % 2 = 0) GROUP BY nation, nation_key, region, year(day), month(day)),
  both_m AS (SELECT *, 2 AS rank FROM wm UNION ALL SELECT *, false, 1 FROM rm), one AS (SELECT * FROM both_m QUALIFY row_number() OVER (PARTITION BY series, region, year, month ORDER BY value IS NULL, rank) = 1),
  yy AS (SELECT year, row_number() OVER (ORDER BY year) AS k FROM (SELECT DISTINCT year FROM one)), g12 AS (SELECT series, region, year, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM (SELECT DISTINCT series, region, year FROM one)),
  cm AS (SELECT g.series, g.region, g.year, g.month, o.value, coalesce(iw, false) AS iw, (k - 1) * 12 + g.month AS time_seq FROM g12 g JOIN yy ON yy.year = g.year LEFT JOIN one o ON o.series = g.series AND o.year = g.year AND o.month = g.month),
  {_sql_filled('cm', 'fm', 11)},
  ms AS (SELECT series, region, year, month, filled AS value, CASE WHEN count(*) OVER w = count(filled) OVER w THEN CAST(sum(filled) OVER w AS BIGINT) END AS annual_total, iw AS imputed_weekly, gap AS imputed_monthly FROM fm WINDOW w AS (PARTITION BY series, year)
    UNION ALL SELECT series, region, year, CAST(unnest(range(1, 13)) AS INTEGER), NULL, t, false, false FROM (SELECT nation AS series, region, CAST(year(day) AS INTEGER) AS year, CAST(sum(value) AS BIGINT) AS t FROM daily WHERE nation_key % 3 = 2 GROUP BY ALL)),
  series_months AS (SELECT series, region, year, month, CASE WHEN annual_total = 0 THEN 0 ELSE value END AS value, annual_total, imputed_weekly, imputed_monthly FROM ms)"""


def _means(df):
    """A predictor that SQL can repeat: the series' mean."""
    return df.withColumn("pred_mean", F.avg("value").over(Window.partitionBy("series")))


@query(f"WITH {_W3} SELECT * FROM series_months")
def w3_monthly_series(spark, sf_dir):
    return jobs.monthly_series(*_sources(spark, sf_dir), predictor=_means)


_GIVEN = f"""{_W3}, cells AS (SELECT *, value IS NOT NULL AND NOT imputed_weekly AND NOT imputed_monthly AS locked, 1 AS pred_mean FROM series_months), {ESTIMATES[ESTIMATES.index('drawn AS (SELECT *, unnest'):]}""".replace(
    SQL_Y, "(month * 31 + draw * 17 + year) % 97 + 1"
)


@query(f"""WITH {_GIVEN} SELECT e.series, e.region, e.year, e.month, e.annual_total, e.locked, imputed_weekly, imputed_monthly, m.value IS NULL AND NOT imputed_weekly AND NOT imputed_monthly AS disaggregated_yearly, scaled, scaled_lwr, scaled_upr
  FROM estimates e JOIN series_months m ON m.series = e.series AND m.year = e.year AND m.month = e.month""")
def w3_publish_given(spark, sf_dir):
    """Months that add up to the totals, from 300 given draws in place of random ones."""
    months = jobs.monthly_series(*_sources(spark, sf_dir), predictor=_means)
    draws = F.transform(F.sequence(F.lit(0), F.lit(N_DRAWS - 1)), lambda draw: ((F.col("month") * 31 + draw * 17 + F.col("year")) % 97 + 1).cast("bigint"))
    return jobs.publish_months(months.withColumns({"draws": draws, "pred_mean": F.lit(1.0)}))


@query()
def w3_publish_months(spark, sf_dir):
    """Random draws; the tests hold that months add up to the totals and observed ones stay."""
    return jobs.publish_months(jobs.drawn_months(jobs.monthly_series(*_sources(spark, sf_dir))))


@query(f"WITH {RUNS} SELECT series, run_id, count(*) AS run_len, min(start_date) AS first_week, max(start_date) AS last_week FROM numbered WHERE value IS NULL GROUP BY ALL")
def flagship_weekly_gaps(spark, sf_dir):
    """Days to weeks, the completed calendar, and the runs of missing weeks."""
    daily = views.daily(spark, sf_dir).select("series", "region", "day", "value")
    weeks = rollup.days_to_weeks(daily, "series", "region").select("series", "region", "year", "start_date", "value")
    runs = series.runs(series.complete_weeks(weeks, "series", "region"), "series", order="start_date")
    return runs.select("series", "run_id", "run_len", F.col("first").alias("first_week"), F.col("last").alias("last_week"))


