"""The three jobs: reports to selected records, coverage to annual totals, and
gaps to published months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions import calendar as cal
from countloom.operators import calibrate, dedup, harmonise, predict, reconcile, rollup, select, series
from countloom.sources.publish import checked, repeats
from countloom.sources.shared import saved


def select_and_scale(reports: DataFrame, *, special: tuple[str, ...] = select.SPECIAL) -> DataFrame:
    """Job 1: deduplicated reports in; the best record of each series and year out, as
    series, year, t_res, start_date, value, scaled. Where the annual report exceeds
    complete sub-annual ones, these are scaled to it; else they are taken as they are.
    """
    reports = saved(reports, "reports")  # feeds the counts, the extraction and the scaling
    levels = saved(rollup.level_counts(reports), "levels")
    cases, rest = select.scaling_cases(saved(select.best_records(levels, special=special), "best"))
    taken = select.extract(reports, rest, nation_sum=rollup.units_to_nation)
    own = reports.withColumn("level", F.regexp_replace("s_res", "Admin", "a"))
    source = select.sub_annual_fallback(levels).join(cases.select("series", "year", F.col("final_sum").alias("target")), ["series", "year"])
    parts = own.join(source.select("series", "year", "t_res", "level", "target"), ["series", "year", "t_res", "level"])
    parts = parts.groupBy("series", "year", "t_res", "start_date", "target").agg(F.sum("value").alias("value"))
    columns = ["series", "year", "t_res", "start_date", "value", "scaled", "scaled_to_annual"]
    scaled = select.scale_to_total(parts, "series", "year").withColumn("scaled_to_annual", F.lit(True)).select(*columns)
    return scaled.unionByName(taken.withColumn("scaled", F.col("value")).select(*columns))


def annual_totals(
    reports: DataFrame, external: DataFrame, first: DataFrame, assumed: DataFrame, first_year: int, last_year: int, *, priority: tuple[str, ...] = ("ad_hoc_data", "main"), k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Job 2: selected reports (series, year, t_res, start_date, end_date, value, cat), external
    estimates (series, year, estimate), first years of local transmission (series, first_year)
    and series whose missing years count as zero (series) in. Out:

    coverage, one row for every series and year: series, year, annual_total, data_source,
    cat_model, t_res, n_record, prop; and the reports with an annual record for each
    assumed total. Series without any count go from both. Keys are checked as the tables are written.
    """
    known = calibrate.zero_before_first(reports.select("series", "year", "t_res", "start_date", "end_date", "value", "cat"), first, first_year)
    january, december = cal.year_bounds("year")
    annual = F.col("cat") == "first_year"
    known = saved(known.withColumns({"start_date": F.when(annual, january).otherwise(F.col("start_date")), "end_date": F.when(annual, december).otherwise(F.col("end_date"))}), "known")
    counted = known.groupBy("series", "year", "t_res", "cat").agg(F.count(F.lit(1)).alias("n_record"), F.sum("value").alias("_sum"))
    counted = saved(counted, "counted")  # a row a series, year, resolution and source
    source = calibrate.one_source(counted.select("series", "year", "t_res", "cat"), priority)
    share = rollup.share_of_year(counted.groupBy("series", "year", "t_res").agg(F.sum("n_record").alias("n_record")))
    totals = counted.groupBy("series", "year").agg(F.coalesce(F.sum("_sum"), F.lit(0)).alias("annual_total"))
    own = totals.join(source, ["series", "year"]).join(share, ["series", "year", "t_res"])
    grid = calibrate.model_category(calibrate.year_grid(own, first_year, last_year))
    grid = calibrate.assume_zero(grid.withColumn("data_source", F.coalesce("cat", F.lit(calibrate.NO_DATA))), assumed)
    grid = grid.withColumn("cat_model", F.when(F.col("assumed_zero"), calibrate.NONE).otherwise(F.col("cat_model")))
    own = calibrate.calibrate(grid, external).withColumn("annual_total", F.col("annual_total2"))
    own = saved(calibrate.drop_zero_series(saved(own, "calibrated")), "own")
    filled = calibrate.impute_nearest(own, k=k)
    made = F.col("imputed") | F.col("data_source").isin("assumed_zero", "calibrated")
    category = F.when(F.col("imputed") & (F.col("annual_total") != 0), calibrate.DISAGGREGATE).when(F.col("imputed"), calibrate.NONE).otherwise(F.col("cat_model"))
    filled = filled.withColumns({"_made": made, "cat_model": category, "data_source": F.when(F.col("imputed"), "Median_from_neighbors").otherwise(F.col("data_source"))})
    filled = filled.withColumns({"t_res": F.when(made, "Year").otherwise(F.col("t_res")), "n_record": F.when(made, 1).otherwise(F.col("n_record")), "prop": F.when(made, 1.0).otherwise(F.col("prop"))})
    columns = ["series", "year", "annual_total", "data_source", "cat_model", "t_res", "n_record", "prop"]
    coverage = checked(filled.select(*columns, "_made"), "coverage", **{"years that repeat": repeats("series", "year")})
    kept = known.join(coverage.select("series").distinct(), "series", "left_semi")
    records = calibrate.append_assumed(kept, coverage.where("_made").select("series", "year", "annual_total"))
    records = records.withColumns({"start_date": F.coalesce("start_date", january), "end_date": F.coalesce("end_date", december)})
    return coverage.select(*columns), checked(records, "records", **{"periods that repeat": repeats("series", "start_date", "end_date")})


def months_from_weeks(weekly: DataFrame, *, most_weeks: int = 4, predictor=predict.seasonal_predictor) -> DataFrame:
    """Weekly counts (series, region, start_date, year, value) to months: calendar
    completed, gaps of up to ``most_weeks`` filled from predictions, then summed by the
    year's pattern. Columns series, region, year, month, value, imputed_weekly."""
    weeks = series.complete_weeks(weekly, "series", "region").where("week is not null").withColumn("season", cal.folded_week("week"))
    weeks = predictor(weeks).withColumn("pred_mean", F.floor("pred_mean"))
    filled = series.fill_gaps(weeks, "series", most=most_weeks).withColumn("_known", F.coalesce("value", "filled"))
    filled = saved(series.with_pattern(filled, "series", value="_known").where("series is not null and year is not null"), "filled")
    month = cal.month_of_week("start_date", F.date_add("start_date", 6), "year").cast("int")
    return rollup.filled_weeks_to_months(filled.withColumn("month", month), "series", "region").drop("pattern")


def monthly_series(weekly: DataFrame, monthly: DataFrame, annual: DataFrame, *, most_weeks: int = 4, most_months: int = 11, predictor=predict.seasonal_predictor) -> DataFrame:
    """Job 3, first half: weekly counts, monthly counts (series, region, year, month,
    value) and annual totals (series, region, year, value) in; twelve months of every
    series and year out: series, region, year, month, value, annual_total,
    imputed_weekly, imputed_monthly.

    Of a month that is known twice a known count wins, then the monthly report. Gaps of
    up to ``most_months`` are filled from predictions. The total of a year is the sum of
    its months, null if one is missing; years that have an annual total only
    are expanded to months without counts. All months of a year with total zero are zero.
    A series-year with both, or without twelve months, ends the job.
    """
    own = months_from_weeks(weekly, most_weeks=most_weeks, predictor=predictor).withColumn("source_rank", F.lit(2))
    both = own.unionByName(monthly.select("series", "region", "year", "month", "value", F.lit(False).alias("imputed_weekly"), F.lit(1).alias("source_rank")))
    months = series.complete_months(dedup.prefer_known(both, "series", "region", "year", "month").drop("source_rank"), "series", "region")
    months = predictor(saved(months, "months").withColumn("season", F.col("month")))
    months = series.fill_gaps(months.withColumn("pred_whole", F.floor("pred_mean")), "series", pred="pred_whole", most=most_months)
    columns = ["series", "region", "year", "month", "value", "annual_total", "imputed_weekly", "imputed_monthly"]
    filled = months.select("series", "region", "year", "month", F.col("filled").alias("value"), F.coalesce("imputed_weekly", F.lit(False)).alias("imputed_weekly"), F.col("filled_gap").alias("imputed_monthly"))
    filled = rollup.attach_annual(filled, "series", "year").select(*columns)
    expanded = rollup.years_to_months(annual.withColumn("value", F.col("value").cast("bigint"))).withColumns({"imputed_weekly": F.lit(False), "imputed_monthly": F.lit(False)})
    wrong = F.count(F.lit(1)).over(Window.partitionBy("series", "year")) != 12
    out = checked(filled.unionByName(expanded.select(*columns)), "twelve", **{"years that haven't twelve months": wrong})
    return out.withColumn("value", series.zero_years(F.col("value"), F.col("annual_total")).cast("bigint"))


def drawn_months(months: DataFrame, *, n_draws: int = 300) -> DataFrame:
    """``draws`` of every month of ``monthly_series``, by predictions from all months."""
    predicted = predict.seasonal_predictor(months.withColumn("season", F.col("month")))
    return reconcile.draw_counts(saved(predicted, "predicted"), "series", "year", "month", n_draws=n_draws)


def publish_months(drawn: DataFrame) -> DataFrame:
    """Job 3, second half: months of ``monthly_series`` with ``draws`` and ``pred_mean`` in;
    whole counts that add up to the annual totals out, with bounds and flags.

    Observed months are locked, imputed ones aren't. A total below zero counts as zero.
    A year without a total keeps the estimates of its draws. Months that don't add up
    to a total end the job.
    """
    locked = F.col("value").isNotNull() & ~F.col("imputed_weekly") & ~F.col("imputed_monthly")
    total = F.when(F.col("annual_total") < 0, 0).otherwise(F.col("annual_total"))
    by_year = F.col("value").isNull() & ~F.col("imputed_weekly") & ~F.col("imputed_monthly")
    own = drawn.withColumns({"locked": locked, "annual_total": total.cast("bigint"), "disaggregated_yearly": by_year})
    raked = reconcile.summarise_draws(reconcile.rake(own, "series", "year")).drop("draws", "raked")
    columns = ["series", "region", "year", "month", "annual_total", "locked", "imputed_weekly", "imputed_monthly", "disaggregated_yearly", "scaled", "scaled_lwr", "scaled_upr"]
    own = reconcile.whole_estimates(raked, "series", "year").select(*columns)
    off = F.sum("scaled").over(Window.partitionBy("series", "year")) != F.col("annual_total")
    return checked(own, "published", **{"months that don't add up to the total": off})


def clean_weekly(reports: DataFrame) -> DataFrame:
    """Weekly reports of several sources to one a series and week: sources that lose to
    another over the same span go, then the largest of what is left stays."""
    return dedup.keep_largest(dedup.drop_losing_spans(reports, "Week"))


def clean_reports(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """Front of job 1, for all resolutions: reports that a rule excludes go; weeks at the turn
    of the year get their year; sources that lose to another over the same span go, for
    months, weeks and years; then the largest report of a place and period stays.
    Columns full_name, series, start_date, end_date, year, t_res, source, value."""
    out = cal.align_year(harmonise.exclude(reports, rules))
    for t_res in ("Month", "Week", "Year"):
        out = dedup.drop_losing_spans(out, t_res, place="full_name")
    return dedup.keep_largest(out, "full_name", "t_res", "start_date", "end_date")
