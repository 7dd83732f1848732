"""Report tables derived from the star-schema tables, for the queries.

Each view has its text in DuckDB's SQL beside it, for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions import calendar as cal
from countloom.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (supplier), nation, nation_key, region, day, value, source, part."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("bigint").alias("value"), F.col("l_linestatus").alias("source"),
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"),
    )
    return lines.join(_places(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select("series", "nation", "nation_key", "region", "day", "value", "source", "part", "flag")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("series"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation"), "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return suppliers.join(nations, F.col("s_nationkey") == F.col("nation_key")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))


DAILY = """daily AS (
  SELECT s_name AS series, n_name AS nation, n_nationkey AS nation_key, r_name AS region, CAST(l_shipdate AS DATE) AS day,
         CAST(l_quantity AS BIGINT) AS value, l_linestatus AS source, l_partkey AS part, l_returnflag AS flag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sql_week_start(day: str) -> str:
    return f"({day} - CAST(dayofweek({day}) AS INTEGER))"


def sql_epi_year(day: str) -> str:
    return f"CAST(year({sql_week_start(day)} + 3) AS INTEGER)"


def sql_epi_week(day: str) -> str:
    return f"CAST((dayofyear({sql_week_start(day)} + 3) + 6) // 7 AS INTEGER)"


def sql_epi_start(year: str, week: str) -> str:
    fourth = f"make_date(CAST({year} AS BIGINT), 1, 4)"
    return f"({sql_week_start(fourth)} + CAST(7 * (({week}) - 1) AS INTEGER))"


def sql_weeks(year: str) -> str:
    return f"CAST(({sql_epi_start(f'({year}) + 1', '1')} - {sql_epi_start(year, '1')}) // 7 AS INTEGER)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of nations by week, month and year, on three spatial levels: series,
    unit, s_res, t_res, start_date, end_date, year, value, source, region.

    Weeks count all rows, months two thirds of them, years the rest times a factor, so that
    annual totals lie above and below the sums of weeks and months.
    """
    own = daily(spark, sf_dir)
    level = F.concat(F.lit("Admin"), F.pmod("part", F.lit(3)).cast("string"))
    week = cal.week_start("day")
    first_day, factor = F.make_date(F.year("day"), F.lit(1), F.lit(1)), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(10)), (F.pmod("nation_key", F.lit(3)) + 1).cast("int"))

    def report(t_res: str, start, end, year, value):
        return F.struct(F.lit(t_res).alias("t_res"), start.alias("start_date"), end.alias("end_date"), year.alias("year"), value.alias("value"))

    weekly = report("Week", week, F.date_add(week, 6), cal.epi_year("day"), F.col("value"))
    monthly = report("Month", F.to_date(F.trunc("day", "month")), F.last_day("day"), F.year("day"), F.col("value"))
    annual = report("Year", first_day, F.make_date(F.year("day"), F.lit(12), F.lit(31)), F.year("day"), (F.col("value") * factor).cast("bigint"))
    # chosen without a lambda, and sources kept as the codes of their one letter: all of it is generated code and hash aggregation
    kinds = F.when(F.col("flag").isin("A", "R"), F.array(weekly, monthly)).when(F.col("flag") == "N", F.array(weekly, annual)).otherwise(F.array(weekly))
    rows = own.select(F.col("nation").alias("series"), F.when(level != "Admin0", F.col("series")).alias("unit"), level.alias("s_res"), "region", "source", F.explode(kinds).alias("k"))
    keys = ["series", "unit", "s_res", "region", "k.t_res", "k.start_date", "k.end_date", "k.year"]
    return rows.groupBy(*keys).agg(F.sum("k.value").alias("value"), F.char(F.min(F.ascii("source"))).alias("source"))


REPORTS = f"""{DAILY}, lines AS (
  SELECT nation AS series, CASE WHEN part % 3 <> 0 THEN series END AS unit, 'Admin' || (part % 3) AS s_res, region, source, flag, nation_key, day, value FROM daily
), stacked AS (
  SELECT series, unit, s_res, region, source, 'Week' AS t_res, {sql_week_start('day')} AS start_date, {sql_week_start('day')} + 6 AS end_date, {sql_epi_year('day')} AS year, value FROM lines
  UNION ALL
  SELECT series, unit, s_res, region, source, 'Month', CAST(date_trunc('month', day) AS DATE), last_day(day), CAST(year(day) AS INTEGER), value FROM lines WHERE flag IN ('A', 'R')
  UNION ALL
  SELECT series, unit, s_res, region, source, 'Year', make_date(year(day), 1, 1), make_date(year(day), 12, 31), CAST(year(day) AS INTEGER),
         value * CASE nation_key % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 10 END FROM lines WHERE flag = 'N'
), reports AS (
  SELECT series, unit, s_res, region, t_res, start_date, end_date, year, CAST(sum(value) AS BIGINT) AS value, min(source) AS source
  FROM stacked GROUP BY ALL)"""


def weekly_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts of suppliers by source, two of which often report the same week;
    every seventh week of source F is reported again with one more."""
    own = daily(spark, sf_dir)
    week = cal.week_start("day")
    rows = own.groupBy("series", "region", week.alias("start_date"), "source").agg(F.sum("value").alias("value"))
    rows = rows.withColumns({"end_date": F.date_add("start_date", 6), "year": cal.epi_year("start_date"), "t_res": F.lit("Week")})
    again = rows.where((F.col("source") == "F") & (F.pmod(F.datediff("start_date", F.lit("1970-01-04").cast("date")) / 7, F.lit(7)) == 0))
    return rows.unionByName(again.withColumns({"value": F.col("value") + 1, "source": F.lit("G")}))


WEEKLY_SOURCES = f"""{DAILY}, first_weeks AS (
  SELECT series, region, {sql_week_start('day')} AS start_date, source, CAST(sum(value) AS BIGINT) AS value FROM daily GROUP BY ALL
), dated AS (
  SELECT *, start_date + 6 AS end_date, {sql_epi_year('start_date')} AS year, 'Week' AS t_res FROM first_weeks
), weekly_sources AS (
  SELECT series, region, start_date, source, value, end_date, year, t_res FROM dated
  UNION ALL
  SELECT series, region, start_date, 'G', value + 1, end_date, year, t_res FROM dated WHERE source = 'F' AND ((start_date - DATE '1970-01-04') // 7) % 7 = 0)"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One count a supplier and week: series, region, start_date, year, value.

    Lines are summed under their supplier's number before they get its names, and then under the names, since several
    suppliers may have one; both in tasks of a fixed number of lines. The rows of a series end in one task, so windows by
    series and year need no other shuffle.
    """
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()  # from the files' footers
    lines = lines.select("l_suppkey", cal.week_start(F.to_date("l_shipdate")).alias("start_date"), F.col("l_quantity").cast("bigint").alias("value"))
    sums = spread(lines, n, "l_suppkey").groupBy("l_suppkey", "start_date").agg(F.sum("value").alias("value"))
    named = sums.join(_places(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select("series", "region", "start_date", "value")
    own = spread(named, n, "series").groupBy("series", "region", "start_date").agg(F.sum("value").alias("value"))
    return own.select("series", "region", "start_date", cal.epi_year("start_date").alias("year"), "value")


WEEKLY = f"""{DAILY}, weekly AS (
  SELECT series, region, {sql_week_start('day')} AS start_date, {sql_epi_year('day')} AS year, CAST(sum(value) AS BIGINT) AS value FROM daily GROUP BY ALL)"""


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual counts of nations, null (not reported) in one of four years: series,
    region, year, value."""
    reported = F.pmod(F.col("nation_key") + F.year("day"), F.lit(4)) != 0
    own = daily(spark, sf_dir)
    return own.groupBy(F.col("nation").alias("series"), "region", F.year("day").alias("year")).agg(F.sum(F.when(reported, F.col("value"))).alias("value"))


YEARLY = f"""{DAILY}, yearly AS (
  SELECT nation AS series, region, CAST(year(day) AS INTEGER) AS year, CAST(sum(CASE WHEN (nation_key + year(day)) % 4 <> 0 THEN value END) AS BIGINT) AS value FROM daily GROUP BY ALL)"""


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual totals of orders by nation, as another body's estimates: series, year, estimate."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("series"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("series", "year").agg(F.count(F.lit(1)).alias("estimate"))


EXTERNAL = """external AS (
  SELECT n_name AS series, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS estimate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
