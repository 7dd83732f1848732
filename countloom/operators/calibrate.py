"""Coverage of series by year, calibration of estimates, imputed annual totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NONE, DISAGGREGATE, IMPUTE, NO_DATA = "No_modelling_required", "Annual_disaggregation", "Sub_annual_imputation", "No_data"


def year_grid(df: DataFrame, first: int, last: int, *, series: str = "series") -> DataFrame:
    """Every series and year, with the columns of ``df`` or nulls."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    return df.select(series).distinct().select(series, years).join(df, [series, "year"], "left")


def one_source(df: DataFrame, priority: tuple[str, ...] = ("ad_hoc_data", "main"), *extra: str) -> DataFrame:
    """One row a series and year (and ``extra`` columns): that of the first source in ``priority``; others follow by name."""
    rank = F.lit(len(priority))
    for k, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col("cat") == name, k).otherwise(rank)
    w = Window.partitionBy("series", "year", *extra).orderBy(rank, F.asc_nulls_last("cat"), "t_res")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def model_category(df: DataFrame) -> DataFrame:
    """cat_model from prop, t_res and annual_total. A share above 1 has none: it is an
    error in the data and counted as such."""
    prop, total, annual = F.col("prop"), F.col("annual_total"), F.col("t_res") == "Year"
    rule = (
        F.when(prop.isNull(), NO_DATA).when(annual & (total == 0), NONE).when(annual & (prop == 1), DISAGGREGATE).when(prop == 1, NONE).when(prop < 1, IMPUTE)
    )
    return df.withColumn("cat_model", rule)


def before_first_year(reports: DataFrame, first: DataFrame) -> DataFrame:
    """Reports of years before the first local transmission (first: series, first_year) with a count."""
    return reports.join(first, "series").where((F.col("year") < F.col("first_year")) & (F.col("value") > 0)).drop("first_year")


def zero_before_first(reports: DataFrame, first: DataFrame, first_year: int) -> DataFrame:
    """Drops reports of years before the first transmission and adds one annual zero
    for each such year from ``first_year`` on."""
    kept = reports.join(first, "series", "left").where(F.col("first_year").isNull() | (F.col("year") >= F.col("first_year"))).drop("first_year")
    years = F.explode(F.when(F.col("first_year") > first_year, F.sequence(F.lit(first_year), F.col("first_year") - 1)))
    zeros = first.select("series", years.alias("year"))
    zeros = zeros.withColumns({"value": F.lit(0).cast(reports.schema["value"].dataType), "t_res": F.lit("Year"), "cat": F.lit("first_year")})
    return kept.unionByName(zeros, allowMissingColumns=True)


def assume_zero(grid: DataFrame, listed: DataFrame) -> DataFrame:
    """Years without data of listed series count as zero, marked ``assumed_zero``."""
    own = grid.join(listed.select("series").distinct().withColumn("_listed", F.lit(True)), "series", "left")
    fill = F.coalesce(F.col("_listed"), F.lit(False)) & F.col("annual_total").isNull()
    return own.withColumns({"assumed_zero": fill, "annual_total": F.when(fill, 0).otherwise(F.col("annual_total")).cast("bigint"), "data_source": F.when(fill, "assumed_zero").otherwise(F.col("data_source"))}).drop("_listed")


def calibrate(grid: DataFrame, external: DataFrame) -> DataFrame:
    """Fills missing totals with external estimates times the ratio of the two means in
    the series, cut to whole numbers; adds scalar, calibrated and annual_total2.

    One join on (series, year) and one window by series.
    """
    own = grid.join(external.select("series", "year", "estimate"), ["series", "year"], "left")
    w = Window.partitionBy("series")
    scalar = F.try_divide(F.avg("annual_total").over(w), F.avg("estimate").over(w))
    own = own.withColumn("scalar", scalar).withColumn("calibrated", (F.col("estimate") * F.col("scalar")).cast("bigint"))
    fill = F.col("annual_total").isNull() & F.col("calibrated").isNotNull()
    return own.withColumns(
        {
            "annual_total2": F.coalesce("annual_total", "calibrated"),
            "data_source": F.when(fill, "calibrated").when(F.col("annual_total").isNull(), "No_data").otherwise(F.col("data_source")),
            "cat_model": F.when(fill & (F.col("calibrated") != 0), DISAGGREGATE).when(fill, NONE).when(F.col("annual_total").isNull(), NO_DATA).otherwise(F.col("cat_model")),
        }
    )


def no_scalar(calibrated: DataFrame) -> DataFrame:
    """Series with gaps and estimates, but nothing to calibrate them by."""
    return calibrated.where(F.col("annual_total").isNull() & F.col("estimate").isNotNull() & F.col("scalar").isNull()).select("series").distinct()


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of two lists with ``where``: both, left or right."""
    a, b = left.select(column).distinct().withColumn("_a", F.lit(True)), right.select(column).distinct().withColumn("_b", F.lit(True))
    place = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, column, "full").select(column, place.alias("where"))


def drop_zero_series(df: DataFrame, *, value: str = "annual_total") -> DataFrame:
    """Without series whose total over all years is zero; one null keeps a series."""
    zero = df.groupBy("series").agg(F.sum(value).alias("_t"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all")).where("_t = 0 and _n = _all")
    return df.join(zero.select("series"), "series", "left_anti")


def impute_nearest(df: DataFrame, *, k: int = 10, value: str = "annual_total") -> DataFrame:
    """Fills years without a total by the median of the ``k`` nearest observed years of
    the series (ties: the earlier year), cut to a whole number; ``imputed`` marks them.

    One shuffle by series: every row sees its series' observed years, an array of one
    entry a year, from which a gap takes the nearest.
    """
    known = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("year", F.col(value).alias("v")))).over(Window.partitionBy("series"))
    near = F.array_sort(F.transform("_known", lambda x: F.struct(F.abs(x["year"] - F.col("year")).alias("d"), x["year"].alias("y"), x["v"].alias("v"))))
    own = F.array_sort(F.transform(F.slice(near, 1, k), lambda x: x["v"]))
    n = F.size("_near")
    middle = lambda at: F.try_element_at("_near", at.cast("int")).cast("double")
    median = ((middle(F.floor((n + 1) / 2)) + middle(F.floor(n / 2) + 1)) / 2).cast("bigint")
    out = df.withColumn("_known", known).withColumn("_near", F.when(F.col(value).isNull(), own)).withColumn("_median", F.when(F.col(value).isNull() & (n > 0), median))
    fill = F.col(value).isNull() & F.col("_median").isNotNull()
    return out.withColumn("imputed", fill).withColumn(value, F.coalesce(value, "_median")).drop("_known", "_near", "_median")


def append_assumed(df: DataFrame, assumed: DataFrame) -> DataFrame:
    """Annual records for the assumed totals (series, year, annual_total)."""
    own = assumed.select("series", "year", F.col("annual_total").alias("value"), F.lit("Year").alias("t_res"), F.lit("assumed").alias("cat"))
    return df.unionByName(own, allowMissingColumns=True)


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """n, mae and r2 over complete pairs."""
    own = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(left) - F.col(right))).alias("mae"), F.pow(F.corr(left, right), 2.0).alias("r2"))


def zero_complete_months(df: DataFrame, listed: DataFrame) -> DataFrame:
    """All twelve months of each series and year of listed series, absent ones with a
    count of zero; the source is filled downwards, then upwards."""
    own = df.join(listed.select("series").distinct(), "series", "left_semi")
    grid = own.select("series", "year").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    w = Window.partitionBy("series", "year").orderBy("month")
    down = F.last("source", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first("source", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    joined = grid.join(own.select("series", "year", "month", "value", "source"), ["series", "year", "month"], "left")
    return joined.withColumn("_s", F.coalesce(down, up)).select("series", "year", "month", F.coalesce("value", F.lit(0)).alias("value"), F.col("_s").alias("source"))


def outbreak_zeros(df: DataFrame) -> DataFrame:
    """Weekly zeros outside outbreaks (series, year, zero_start, zero_end, one of which
    may be null): from week 1 or up to the end of week 52; one row a series and week."""
    from countloom.functions.calendar import epi_week_end, epi_week_start

    start = F.coalesce("zero_start", epi_week_start("year", F.lit(1)))
    end = F.coalesce("zero_end", epi_week_end("year", F.lit(52)))
    own = df.where(F.col("zero_start").isNotNull() | F.col("zero_end").isNotNull())
    last = F.date_sub(end, 1)
    weeks = own.withColumn("start_date", F.explode(F.when(start <= last, F.sequence(start, last, F.expr("interval 7 days")))))
    w = Window.partitionBy("series", "start_date").orderBy("year")
    out = weeks.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return out.select("series", "year", "start_date", F.date_add("start_date", 6).alias("end_date"), F.lit(0).cast("bigint").alias("value"))
