"""Queries of the selection (F) and calibration (G) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from countloom.operators import calibrate, rollup, select
from countloom.plans import incremental
from countloom.plans.queries_time import COVERAGE, LEVELS
from countloom.plans.registry import query
from countloom.sources import views
from countloom.sources.publish import publish
from countloom.sources.shared import fresh_path, saved
from countloom.sources.views import EXTERNAL, REPORTS, YEARLY, sql_weeks

#: One nation plays the part of a series whose sub-annual reports always win.
_SPECIAL = ("NATION_4", "NATION_7")

BEST = f"""{LEVELS}, cand AS (
  SELECT *, greatest(a0_count, a1_count, a2_count) AS mc, greatest(a0_sum, a1_sum, a2_sum) AS ms, {sql_weeks('year')} AS expected,
         series IN {_SPECIAL} AS special FROM levels
), lev AS (
  SELECT *, CASE WHEN a0_sum = ms THEN 'a0' WHEN a1_sum = ms THEN 'a1' ELSE 'a2' END AS lvl,
         CASE WHEN a0_sum = ms THEN a0_count WHEN a1_sum = ms THEN a1_count ELSE a2_count END AS n, mc / expected AS p FROM cand
), ann AS (SELECT * FROM lev WHERE t_res = 'Year'
), sub AS (
  SELECT *, CASE t_res WHEN 'Week' THEN n >= expected ELSE n = 12 END AS enough FROM lev WHERE t_res <> 'Year'
  QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY CASE WHEN special THEN mc ELSE ms END DESC, CASE WHEN special THEN ms ELSE p END DESC, p DESC, t_res) = 1
), both_kinds AS (
  SELECT coalesce(a.series, s.series) AS series, coalesce(a.year, s.year) AS year, a.ms AS y, s.ms AS s, a.lvl AS alvl, s.lvl AS slvl, a.n AS an, s.n AS sn, s.t_res AS st, s.enough,
         coalesce(a.special, s.special) AS special, a.series IS NOT NULL AS has_a, s.series IS NOT NULL AS has_s
  FROM ann a FULL JOIN sub s ON a.series = s.series AND a.year = s.year
), judged AS (
  SELECT *, enough AND (special OR NOT (s = 0 AND y <> 0)) AS done, CASE WHEN has_a AND has_s AND y > 0 THEN 100.0 * s / y END AS pct FROM both_kinds
), best AS (
  SELECT series, year,
    CASE WHEN NOT has_s OR (has_a AND y > s AND NOT (done AND special)) THEN 'Year' ELSE st END AS t_res,
    CASE WHEN NOT has_s OR (has_a AND y > s AND NOT (done AND special)) THEN alvl ELSE slvl END AS level,
    CASE WHEN NOT has_s OR (has_a AND y > s AND NOT (done AND special)) THEN an ELSE sn END AS final_count,
    CASE WHEN NOT has_s OR (has_a AND y > s AND NOT (done AND special)) THEN y ELSE s END AS final_sum,
    CASE WHEN NOT has_s THEN 'Case 1: Annual only' WHEN NOT has_a THEN 'Case 2: Sub-annual only'
         WHEN NOT done AND y > s THEN CASE WHEN enough THEN 'Sub-annual sum zero - annual selected' ELSE 'Incomplete sub-annual - annual selected' END
         WHEN NOT done THEN 'Incomplete sub-annual - sub-annual selected'
         WHEN y > s AND NOT special THEN 'Annual > sub-annual' WHEN special THEN 'Special country - sub-annual selected' ELSE 'Sub-annual >= Annual' END AS category,
    pct AS pct_of_annual,
    CASE WHEN NOT (has_a AND has_s) THEN coalesce(y, s) WHEN y > s AND NOT (done AND special) THEN y WHEN NOT done THEN s WHEN pct IS NULL THEN NULL WHEN pct >= 80 AND pct < 100 THEN y ELSE s END AS annual_total,
    CASE WHEN has_s THEN CASE WHEN has_a THEN done ELSE enough END END AS complete,
    CASE WHEN NOT has_s THEN 'Case 1: Annual only' WHEN NOT has_a THEN 'Case 2: Sub-annual only' ELSE 'Case 3: Both' END AS "case"
  FROM judged)"""


def _levels(spark, sf_dir):
    return rollup.level_counts(views.reports(spark, sf_dir))


def _best(spark, sf_dir):
    return select.best_records(_levels(spark, sf_dir), special=_SPECIAL)


def _regions(spark, sf_dir):
    nations, regions = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("series"), F.col("r_name").alias("region"))


_REGIONS = "regions AS (SELECT n_name AS series, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {BEST} SELECT * REPLACE (round(pct_of_annual, 6) AS pct_of_annual) FROM best")
def f_best_records(spark, sf_dir):
    return _best(spark, sf_dir).withColumn("pct_of_annual", F.round("pct_of_annual", 6))


@query(f"WITH {BEST} SELECT * REPLACE (round(pct_of_annual, 6) AS pct_of_annual) FROM best")
def f_best_incremental(spark, sf_dir):
    """The same from two refreshes: the years to 1998 first, then all of them, of which only the new ones are selected."""
    reports = saved(views.reports(spark, sf_dir), "reports")
    path, state = fresh_path(spark, "by-year"), fresh_path(spark, "state")
    for years in ("year <= 1998", "year > 1998"):
        publish(reports.where(years), path, "year")
        done = incremental.refresh_best(spark, path, state, special=_SPECIAL)
    return done.best.withColumn("pct_of_annual", F.round("pct_of_annual", 6))


_WHY = f"""{BEST}, why AS (SELECT b.series, b.year, b.t_res AS taken, b.category, j.has_a AND j.has_s AS two, CASE b.category
    WHEN 'Sub-annual sum zero - annual selected' THEN 'Sub-annual complete but sum is zero (annual = ' || j.y || ')'
    WHEN 'Incomplete sub-annual - annual selected' THEN 'Sub-annual incomplete (' || u.mc || ' ' || lower(u.t_res) || 's) and annual (' || j.y || ') > sub-annual (' || j.s || ')'
    WHEN 'Incomplete sub-annual - sub-annual selected' THEN 'Sub-annual incomplete (' || u.mc || ' ' || lower(u.t_res) || 's) but sub-annual (' || j.s || ') >= annual (' || j.y || ')'
    WHEN 'Annual > sub-annual' THEN 'Annual (' || j.y || ') > complete sub-annual (' || j.s || ')'
    ELSE 'Complete sub-annual selected (' || coalesce(regexp_replace(CAST(CAST(round(b.pct_of_annual, 1) AS DECIMAL(20, 1)) AS VARCHAR), '\\.0$', ''), 'NA') || '% of annual)' END AS reason
  FROM best b JOIN judged j ON j.series = b.series AND j.year = b.year LEFT JOIN sub u ON u.series = b.series AND u.year = b.year),
  rest AS (SELECT l.series, l.year, l.t_res, two, taken, category, reason, NOT two OR (l.t_res = 'Year') = (taken = 'Year') AS other FROM levels l JOIN why w ON l.series = w.series AND l.year = w.year WHERE l.t_res <> taken)"""


@query(f"""WITH {_WHY} SELECT series, year, t_res, CASE WHEN other AND t_res = 'Year' THEN 'Other annual record' WHEN other THEN 'Other sub-annual record' ELSE reason END AS reason_unselected,
  CASE WHEN NOT other THEN category END AS relationship_category FROM rest""")
def f_unselected(spark, sf_dir):
    return select.unselected(saved(_levels(spark, sf_dir), "levels"), special=_SPECIAL)


@query(f"""WITH {BEST} SELECT j.series, j.year, j.y AS annual_sum, alvl AS annual_level, j.s AS subannual_sum, slvl AS subannual_level, st AS subannual_type, sn AS subannual_count, done AS subannual_is_complete,
  round(pct, 6) AS pct_of_annual, b.category AS relationship_category, b.t_res AS selected_type, j.special AS is_special_series FROM judged j JOIN best b ON j.series = b.series AND j.year = b.year WHERE has_a AND has_s""")
def f_relationship_table(spark, sf_dir):
    return select.relationships(_levels(spark, sf_dir), special=_SPECIAL).withColumn("pct_of_annual", F.round("pct_of_annual", 6))


@query(f"""WITH {BEST} SELECT category, count(*) AS n, count(DISTINCT series) AS n_series, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
  FROM best WHERE "case" = 'Case 3: Both' GROUP BY category""")
def f_relationships(spark, sf_dir):
    return select.relationship_summary(_best(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query(f"WITH {BEST}, {_REGIONS} SELECT region, year, CAST(sum(final_sum) AS BIGINT) AS total, count(*) AS n_series FROM best JOIN regions USING (series) GROUP BY region, year")
def f_regional_totals(spark, sf_dir):
    return select.regional_totals(_best(spark, sf_dir), _regions(spark, sf_dir))


@query(f"""WITH {BEST} SELECT series, year, t_res, category = 'Annual > sub-annual' AND complete AND t_res = 'Year' AS to_scale FROM best""")
def f_scaling_cases(spark, sf_dir):
    cases, rest = select.scaling_cases(_best(spark, sf_dir))
    return cases.select("series", "year", "t_res", F.lit(True).alias("to_scale")).unionByName(rest.select("series", "year", "t_res", F.lit(False).alias("to_scale")))


_EXTRACT = f"""{BEST}, extracted AS (SELECT r.series, r.start_date, r.end_date, r.year, r.t_res, CAST(sum(r.value) AS BIGINT) AS value, min(r.source) AS source
  FROM reports r JOIN best b ON r.series = b.series AND r.year = b.year AND r.t_res = b.t_res AND replace(r.s_res, 'Admin', 'a') = b.level GROUP BY ALL)"""


@query(f"WITH {_EXTRACT} SELECT *, false AS scaled_to_annual FROM extracted")
def f_extract(spark, sf_dir):
    reports = saved(views.reports(spark, sf_dir), "reports")
    return select.extract(reports, select.best_records(rollup.level_counts(reports), special=_SPECIAL), nation_sum=rollup.units_to_nation)


_FALLBACK = """fallback AS (SELECT series, year, t_res, level, n FROM (
    SELECT series, year, t_res, 'a0' AS level, a0_count AS n FROM levels UNION ALL SELECT series, year, t_res, 'a1', a1_count FROM levels UNION ALL SELECT series, year, t_res, 'a2', a2_count FROM levels)
  WHERE t_res <> 'Year' AND n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY level, t_res) = 1)"""


@query(f"WITH {LEVELS}, {_FALLBACK} SELECT * FROM fallback")
def f_fallback(spark, sf_dir):
    return select.sub_annual_fallback(_levels(spark, sf_dir))


SCALED = f"""{BEST}, {_FALLBACK}, goal AS (SELECT series, year, final_sum AS target FROM best WHERE category = 'Annual > sub-annual' AND complete AND t_res = 'Year'),
  part AS (SELECT r.series, r.year, r.start_date, CAST(sum(r.value) AS BIGINT) AS value, g.target FROM reports r JOIN fallback f ON r.series = f.series AND r.year = f.year AND r.t_res = f.t_res
    AND replace(r.s_res, 'Admin', 'a') = f.level JOIN goal g ON g.series = r.series AND g.year = r.year GROUP BY r.series, r.year, r.start_date, g.target),
  whole AS (SELECT *, sum(value) OVER (PARTITION BY series, year) AS total, CAST(value AS HUGEINT) * target AS product FROM part),
  floors AS (SELECT *, product // total AS low, product % total AS rest FROM whole),
  scaled AS (SELECT series, year, start_date, value, target, CAST(low + CASE WHEN row_number() OVER (PARTITION BY series, year ORDER BY rest DESC, start_date)
    <= target - sum(low) OVER (PARTITION BY series, year) THEN 1 ELSE 0 END AS BIGINT) AS scaled FROM floors)"""


def _scaled(spark, sf_dir):
    reports = saved(views.reports(spark, sf_dir), "reports")  # feeds the counts and the scaling
    levels = rollup.level_counts(reports)
    levels = saved(levels, "levels")
    cases, _ = select.scaling_cases(select.best_records(levels, special=_SPECIAL))
    source = select.sub_annual_fallback(levels).select("series", "year", "t_res", "level")
    own = reports.withColumn("level", F.regexp_replace("s_res", "Admin", "a")).join(source, ["series", "year", "t_res", "level"], "left_semi")
    parts = own.groupBy("series", "year", "start_date").agg(F.sum("value").alias("value"))
    goal = cases.select("series", "year", F.col("final_sum").alias("target"))
    return select.scale_to_total(parts.join(goal, ["series", "year"]), "series", "year")


@query(f"WITH {SCALED} SELECT * FROM scaled")
def f_scale_to_total(spark, sf_dir):
    return _scaled(spark, sf_dir)


@query(f"""WITH {SCALED} SELECT series, year, CAST(sum(value) AS BIGINT) AS sum_before, CAST(sum(scaled) AS BIGINT) AS sum_after, max(target) AS target,
  round(max(target) / sum(value), 6) AS factor FROM scaled GROUP BY series, year""")
def f_scaling_audit(spark, sf_dir):
    return select.scaling_audit(_scaled(spark, sf_dir), "series", "year").withColumn("factor", F.round("factor", 6))


@query(f"""WITH {LEVELS}, thin AS (SELECT * FROM levels WHERE NOT (t_res = 'Year' AND year % 2 = 0)), cs AS (SELECT series, year FROM thin GROUP BY ALL HAVING count(*) FILTER (t_res = 'Year') = 0), {_REGIONS}
  SELECT series, year, region, 'Case 2: Sub-annual only' AS category FROM cs JOIN regions USING (series) WHERE region <> 'ASIA'
  AND series NOT IN (SELECT series FROM reports WHERE source LIKE 'Z%') AND (series, year) NOT IN (SELECT (series, year) FROM reports WHERE t_res = 'Month' AND value > 3000)""")
def f_to_verify(spark, sf_dir):
    reports = saved(views.reports(spark, sf_dir), "reports")
    levels = rollup.level_counts(reports).where("not (t_res = 'Year' and year % 2 = 0)")
    covered = reports.where("t_res = 'Month' and value > 3000").select("series", "year").distinct()
    return select.to_verify(select.best_records(levels, special=_SPECIAL), _regions(spark, sf_dir), skip_regions=("ASIA",), sources=reports, source_like="Z%", covered=covered)


# -- G


def _cover(spark, sf_dir):
    """Coverage of each level with annual totals and sources of different rank."""
    reports = views.reports(spark, sf_dir)
    own = rollup.coverage(reports, "s_res").join(rollup.annual_totals(reports, "t_res", "s_res"), ["series", "year", "t_res", "s_res"])
    return own.withColumn("cat", F.when(F.col("t_res") == "Week", "main").when(F.col("t_res") == "Month", "ad_hoc_data").otherwise("first_year"))


_COVER = f"""{REPORTS}, {COVERAGE}, cov AS (SELECT c.*, c.n_record / c.expected AS prop, r.annual_total, CASE c.t_res WHEN 'Week' THEN 'main' WHEN 'Month' THEN 'ad_hoc_data' ELSE 'first_year' END AS cat
  FROM cover c JOIN (SELECT series, year, t_res, s_res, CAST(sum(value) AS BIGINT) AS annual_total FROM reports GROUP BY ALL) r USING (series, year, t_res, s_res))"""
_GRID = f"{YEARLY}, grid AS (SELECT s.series, CAST(y.year AS INTEGER) AS year, v.region, v.value AS annual_total FROM (SELECT DISTINCT series FROM yearly) s, (SELECT unnest(range(1994, 2004)) AS year) y LEFT JOIN yearly v ON v.series = s.series AND v.year = y.year)"


def _grid(spark, sf_dir):
    return calibrate.year_grid(views.yearly(spark, sf_dir), 1994, 2003).withColumnRenamed("value", "annual_total")


@query(f"WITH {_GRID} SELECT * FROM grid")
def g_year_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"""WITH {_COVER} SELECT series, year, s_res, t_res, cat, n_record FROM cov QUALIFY row_number() OVER (PARTITION BY series, year, s_res ORDER BY CASE cat WHEN 'ad_hoc_data' THEN 0 WHEN 'main' THEN 1 ELSE 2 END) = 1""")
def g_one_source(spark, sf_dir):
    return calibrate.one_source(_cover(spark, sf_dir), ("ad_hoc_data", "main"), "s_res").select("series", "year", "s_res", "t_res", "cat", "n_record")


@query(f"""WITH {_COVER} SELECT series, year, s_res, t_res, CASE WHEN prop IS NULL THEN 'No_data' WHEN t_res = 'Year' AND annual_total = 0 THEN 'No_modelling_required'
  WHEN t_res = 'Year' AND prop = 1 THEN 'Annual_disaggregation' WHEN prop = 1 THEN 'No_modelling_required' WHEN prop < 1 THEN 'Sub_annual_imputation' END AS cat_model FROM cov""")
def g_model_category(spark, sf_dir):
    return calibrate.model_category(_cover(spark, sf_dir)).select("series", "year", "s_res", "t_res", "cat_model")


_FIRST = "first AS (SELECT n_name AS series, CAST(1996 + n_nationkey % 4 AS INTEGER) AS first_year FROM nation WHERE n_nationkey % 2 = 0)"


def _first(spark, sf_dir):
    nations = views.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    return nations.select(F.col("n_name").alias("series"), (1996 + F.col("n_nationkey") % 4).cast("int").alias("first_year"))


@query(f"""WITH {YEARLY}, {_FIRST} SELECT y.series, y.region, y.year, y.value, 'Year' AS t_res, 'main' AS cat FROM yearly y LEFT JOIN first f USING (series) WHERE f.first_year IS NULL OR y.year >= f.first_year
  UNION ALL SELECT series, NULL, CAST(unnest(range(1994, first_year)) AS INTEGER), 0, 'Year', 'first_year' FROM first""")
def g_zero_before_first(spark, sf_dir):
    own = views.yearly(spark, sf_dir).withColumns({"t_res": F.lit("Year"), "cat": F.lit("main")})
    return calibrate.zero_before_first(own, _first(spark, sf_dir), 1994)


@query(f"WITH {YEARLY}, {_FIRST} SELECT y.* FROM yearly y JOIN first f USING (series) WHERE y.year < f.first_year AND y.value > 0")
def g_before_first(spark, sf_dir):
    return calibrate.before_first_year(views.yearly(spark, sf_dir), _first(spark, sf_dir))


@query(f"""WITH {_GRID}, f AS (SELECT g.*, g.annual_total IS NULL AND n.n_nationkey % 3 = 0 AS assumed_zero FROM grid g JOIN nation n ON n.n_name = g.series)
  SELECT series, year, region, CASE WHEN assumed_zero THEN 0 ELSE annual_total END AS annual_total, CASE WHEN assumed_zero THEN 'assumed_zero' ELSE 'main' END AS data_source, assumed_zero FROM f""")
def g_assume_zero(spark, sf_dir):
    listed = views.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("series"))
    return calibrate.assume_zero(_grid(spark, sf_dir).withColumn("data_source", F.lit("main")), listed)


_CAL = f"""{_GRID}, {EXTERNAL}, joined AS (SELECT g.*, e.estimate, avg(g.annual_total) OVER w / nullif(avg(e.estimate) OVER w, 0) AS scalar
    FROM grid g LEFT JOIN external e ON e.series = g.series AND e.year = g.year WINDOW w AS (PARTITION BY g.series)),
  calib AS (SELECT *, CAST(trunc(estimate * scalar) AS BIGINT) AS calibrated FROM joined)"""


def _calibrated(spark, sf_dir):
    grid = _grid(spark, sf_dir).withColumns({"data_source": F.lit("main"), "cat_model": F.lit("No_modelling_required")})
    return calibrate.calibrate(grid, views.external(spark, sf_dir))


@query(f"""WITH {_CAL} SELECT series, year, estimate, round(scalar, 6) AS scalar, calibrated, coalesce(annual_total, calibrated) AS annual_total2,
  CASE WHEN annual_total IS NOT NULL THEN 'main' WHEN calibrated IS NOT NULL THEN 'calibrated' ELSE 'No_data' END AS data_source,
  CASE WHEN annual_total IS NOT NULL THEN 'No_modelling_required' WHEN calibrated <> 0 THEN 'Annual_disaggregation' WHEN calibrated = 0 THEN 'No_modelling_required' ELSE 'No_data' END AS cat_model FROM calib""")
def g_calibrate(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("series", "year", "estimate", F.round("scalar", 6).alias("scalar"), "calibrated", "annual_total2", "data_source", "cat_model")


@query(f"""WITH {_GRID}, {EXTERNAL}, t AS (SELECT g.series, g.year, CASE WHEN n.n_nationkey % 5 <> 0 THEN g.annual_total END AS v, e.estimate FROM grid g JOIN nation n ON n.n_name = g.series
    LEFT JOIN external e ON e.series = g.series AND e.year = g.year) SELECT DISTINCT series FROM t WHERE v IS NULL AND estimate IS NOT NULL AND series NOT IN (SELECT series FROM t WHERE v IS NOT NULL)""")
def g_no_scalar(spark, sf_dir):
    dark = views.table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("series"), F.lit(True).alias("dark"))
    grid = _grid(spark, sf_dir).join(dark, "series", "left").withColumn("annual_total", F.when(F.col("dark").isNull(), F.col("annual_total"))).drop("dark")
    return calibrate.no_scalar(calibrate.calibrate(grid.withColumns({"data_source": F.lit("main"), "cat_model": F.lit("x")}), views.external(spark, sf_dir)))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 18), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 5)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS "where" FROM a FULL JOIN b ON a.k = b.k""")
def g_overlap(spark, sf_dir):
    a = views.table(spark, sf_dir, "customer").where("c_nationkey < 18").select(F.col("c_nationkey").alias("k"))
    b = views.table(spark, sf_dir, "supplier").where("s_nationkey > 5").select(F.col("s_nationkey").alias("k"))
    return calibrate.overlap(a, b, "k")


@query(f"""WITH {YEARLY}, z AS (SELECT y.series, y.year, CASE WHEN n_nationkey % 4 = 1 THEN 0 WHEN n_nationkey % 4 = 2 THEN CASE WHEN year = 1999 THEN NULL ELSE 0 END ELSE y.value END AS annual_total
    FROM yearly y JOIN nation ON n_name = y.series) SELECT * FROM z WHERE series NOT IN (SELECT series FROM z GROUP BY series HAVING sum(annual_total) = 0 AND count(*) = count(annual_total))""")
def g_drop_zero_series(spark, sf_dir):
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("series"), (F.col("n_nationkey") % 4).alias("k"))
    value = F.when(F.col("k") == 1, 0).when((F.col("k") == 2) & (F.col("year") == 1999), F.lit(None)).when(F.col("k") == 2, 0).otherwise(F.col("value"))
    return calibrate.drop_zero_series(views.yearly(spark, sf_dir).join(nations, "series").select("series", "year", value.cast("bigint").alias("annual_total")))


@query(f"""WITH {_GRID}, near AS (SELECT g.series, g.year, o.annual_total AS v FROM grid g JOIN grid o ON o.series = g.series AND o.annual_total IS NOT NULL WHERE g.annual_total IS NULL
    QUALIFY row_number() OVER (PARTITION BY g.series, g.year ORDER BY abs(o.year - g.year), o.year) <= 10), med AS (SELECT series, year, CAST(trunc(median(v)) AS BIGINT) AS m FROM near GROUP BY ALL)
  SELECT g.series, g.year, coalesce(g.annual_total, m) AS annual_total, g.annual_total IS NULL AND m IS NOT NULL AS imputed FROM grid g LEFT JOIN med ON med.series = g.series AND med.year = g.year""")
def g_impute_nearest(spark, sf_dir):
    return calibrate.impute_nearest(_grid(spark, sf_dir)).select("series", "year", "annual_total", "imputed")


@query(f"""WITH {YEARLY}, {EXTERNAL} SELECT series, year, value, 'Year' AS t_res, 'main' AS cat FROM yearly UNION ALL SELECT series, year, estimate, 'Year', 'assumed' FROM external""")
def g_append_assumed(spark, sf_dir):
    own = views.yearly(spark, sf_dir).select("series", "year", "value", F.lit("Year").alias("t_res"), F.lit("main").alias("cat"))
    return calibrate.append_assumed(own, views.external(spark, sf_dir).withColumnRenamed("estimate", "annual_total"))


@query(f"WITH {_CAL} SELECT count(*) AS n, round(avg(abs(annual_total - calibrated)), 4) AS mae, round(corr(annual_total, calibrated) ** 2, 6) AS r2 FROM calib WHERE annual_total IS NOT NULL AND calibrated IS NOT NULL")
def g_agreement(spark, sf_dir):
    return calibrate.agreement(_calibrated(spark, sf_dir), "annual_total", "calibrated").select("n", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


_SPARSE = """SELECT CAST(part AS VARCHAR) AS series, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(sum(value) AS BIGINT) AS value,
  CASE WHEN min(source) = 'F' THEN 'F' END AS source FROM daily GROUP BY part, year(day), month(day)"""


@query(f"""WITH {views.DAILY}, m AS ({_SPARSE}), own AS (SELECT m.* FROM m JOIN part ON CAST(p_partkey AS VARCHAR) = series WHERE p_size < 9),
  g AS (SELECT DISTINCT series, year FROM own), grid AS (SELECT series, year, unnest(range(1, 13)) AS month FROM g), j AS (SELECT grid.series, grid.year, CAST(grid.month AS INTEGER) AS month, own.value, own.source
    FROM grid LEFT JOIN own ON own.series = grid.series AND own.year = grid.year AND own.month = grid.month)
  SELECT series, year, month, coalesce(value, 0) AS value, coalesce(last_value(source IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(source IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS source FROM j WINDOW w AS (PARTITION BY series, year ORDER BY month)""")
def g_zero_months(spark, sf_dir):
    own = views.daily(spark, sf_dir).groupBy(F.col("part").cast("string").alias("series"), F.year("day").alias("year"), F.month("day").alias("month"))
    own = own.agg(F.sum("value").alias("value"), F.min("source").alias("source")).withColumn("source", F.when(F.col("source") == "F", "F"))
    listed = views.table(spark, sf_dir, "part").where("p_size < 9").select(F.col("p_partkey").cast("string").alias("series"))
    return calibrate.zero_complete_months(own, listed)


_BOUNDS = """SELECT nation AS series, CAST(year(day) AS INTEGER) AS year, CASE WHEN nation_key % 3 = 0 THEN max(day) END AS zero_start, CASE WHEN nation_key % 3 = 1 THEN min(day) + 40 END AS zero_end
  FROM daily GROUP BY nation, year(day), nation_key"""


@query(f"""WITH {views.DAILY}, o AS ({_BOUNDS}), b AS (SELECT series, year, coalesce(zero_start, {views.sql_epi_start('year', '1')}) AS a, coalesce(zero_end, {views.sql_epi_start('year', '52')} + 6) AS z FROM o
    WHERE zero_start IS NOT NULL OR zero_end IS NOT NULL), w AS (SELECT series, year, CAST(unnest(range(a, z, INTERVAL 7 DAY)) AS DATE) AS start_date FROM b)
  SELECT series, year, start_date, start_date + 6 AS end_date, CAST(0 AS BIGINT) AS value FROM w QUALIFY row_number() OVER (PARTITION BY series, start_date ORDER BY year) = 1""")
def g_outbreak_zeros(spark, sf_dir):
    own = views.daily(spark, sf_dir).groupBy(F.col("nation").alias("series"), F.year("day").alias("year"), "nation_key").agg(F.max("day").alias("b"), F.min("day").alias("a"))
    own = own.select("series", "year", F.when(F.col("nation_key") % 3 == 0, F.col("b")).alias("zero_start"), F.when(F.col("nation_key") % 3 == 1, F.date_add("a", 40)).alias("zero_end"))
    return calibrate.outbreak_zeros(own)
