"""Completion of calendars, gaps and their filling, data patterns, and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions import calendar as cal
from countloom.functions.numbering import running_before
from countloom.functions.sums import share_of_null, strict_sum_over


def complete_weeks(df: DataFrame, *keys: str, start: str = "start_date", year: str = "year") -> DataFrame:
    """Every epiweek of each (key, year) that has data, with week and time_seq; weeks
    without data have nulls, and rows off the calendar stay with a null week.

    Each row makes the empty weeks between itself and the next row of its (key, year): one window, no
    calendar, no join and nothing written. The first year, for ``time_seq``, is a scalar subquery over
    the same table, which Spark leaves out where nobody reads the column.
    """
    return with_time_seq(_completed(df, keys, start, year), df, start=start, year=year)


def with_time_seq(weeks: DataFrame, years: DataFrame, *, start: str = "start_date", year: str = "year") -> DataFrame:
    """``time_seq``: numbers the weeks of a calendar from the first of all ``years``."""
    first = years.agg(cal.epi_week_start(F.min(year), F.lit(1)).alias("_first")).scalar()
    return weeks.withColumn("time_seq", F.when(F.col("week").isNotNull(), (F.datediff(start, first) / 7 + 1).cast("int")))


def _completed(df: DataFrame, keys: tuple[str, ...], start: str, year: str) -> DataFrame:
    days, n = F.datediff(start, cal.epi_week_start(year, F.lit(1))), F.coalesce(cal.weeks_in_year(year), F.lit(0))
    own = df.withColumns({"_n": n, "_on": F.when((days % 7 == 0) & days.between(0, 7 * n - 1), (days / 7 + 1).cast("int"))})
    w = Window.partitionBy(*keys, year).orderBy(F.asc_nulls_last("_on"))
    own = own.withColumns({"_next": F.lead("_on").over(w), "_k": F.row_number().over(w)})

    def empty(a: Column, b: Column) -> Column:
        weeks = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
        return F.transform(weeks, lambda k: F.struct(k.alias("week"), F.lit(False).alias("own")))

    before = empty(F.lit(1), F.when(F.col("_k") == 1, F.coalesce("_on", F.col("_n") + 1) - 1).otherwise(0))
    after = empty(F.coalesce(F.col("_on") + 1, F.lit(1)), F.when(F.col("_on").isNull(), 0).otherwise(F.coalesce("_next", F.col("_n") + 1) - 1))
    here = F.array(F.struct(F.col("_on").alias("week"), F.lit(True).alias("own")))
    own = own.withColumn("_w", F.explode(F.concat(before, here, after)))
    columns = [F.col(c) if c in (*keys, year) else F.when(F.col("_w.own"), F.col(c)).alias(c) for c in df.columns if c != start]
    date = F.when(F.col("_w.own"), F.col(start)).otherwise(cal.epi_week_start(year, F.col("_w.week"))).alias(start)
    return own.select(*columns, date, F.col("_w.week").alias("week"))


def complete_months(df: DataFrame, *keys: str, year: str = "year", month: str = "month") -> DataFrame:
    """Twelve months of each (key, year) that has data; time_seq numbers the months of
    all years present, from their distinct list."""
    years = df.select(year).distinct().withColumn("_k", F.row_number().over(Window.orderBy(year)))  # a row a year
    grid = df.select(*keys, year).distinct().withColumn(month, F.explode(F.sequence(F.lit(1), F.lit(12))))
    out = grid.join(df, [*keys, year, month], "left").join(F.broadcast(years), year)
    return out.withColumns({"start_date": cal.month_start(year, month), "time_seq": ((F.col("_k") - 1) * 12 + F.col(month)).cast("int")}).drop("_k")


def complete_years(df: DataFrame, *keys: str, year: str = "year") -> DataFrame:
    """Every year from the first to the last for each key; time_seq counts from 1."""
    span = df.agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(span)).withColumn(year, F.explode(F.sequence("_a", "_b")))
    return grid.join(df, [*keys, year], "left").withColumn("time_seq", (F.col(year) - F.col("_a") + 1).cast("int")).drop("_a", "_b")


def sequence_issues(df: DataFrame, *, date: str = "start_date") -> DataFrame:
    """Dates with several numbers, and numbers with several dates."""
    own = df.where(F.col("time_seq").isNotNull()).select(date, "time_seq").distinct()
    one = own.groupBy(F.col(date).cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    two = own.groupBy(F.col("time_seq").cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(two).where("n > 1")


def missing_share(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share_of_null(value).alias("missing"))


#: Numbers in order are cut into stretches of this length, dates into years.
STRETCH = 52


def _stretch_of(df: DataFrame, order: str) -> Column:
    if isinstance(df.schema[order].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(order)
    return F.floor(F.col(order) / STRETCH)


def _cells(df: DataFrame, keys: tuple[str, ...], stretch: Column, order: str, value: str, reset: str | None) -> DataFrame:
    """is_null, _key (keys and stretch; a struct, so that null keys meet too) and _k, the
    number of the run within it, from 0."""
    own = df.withColumns({"is_null": F.col(value).isNull(), "_key": F.struct(*keys, stretch.alias("_at"))})
    w = Window.partitionBy("_key").orderBy(order)
    changes = F.lag("is_null").over(w) != F.col("is_null")
    if reset:
        changes = changes | (F.lag(reset).over(w) != F.col(reset))
    own = own.withColumn("_b", F.coalesce(changes, F.lit(False)).cast("int"))
    return own.withColumn("_k", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def _pieces(cells: DataFrame, order: str, reset: str | None) -> DataFrame:
    """One row a run within its stretch: its length, first and last in order."""
    what = [F.count(F.lit(1)).alias("_len"), F.min(order).alias("first"), F.max(order).alias("last")]
    if reset:
        what += [F.min_by(reset, order).alias("_ra"), F.max_by(reset, order).alias("_rz")]
    return cells.groupBy("_key", "_k", "is_null").agg(*what)


def _chained(pieces: DataFrame, keys: tuple[str, ...], reset: str | None) -> DataFrame:
    """One row a stretch: _n (its last run's number), _base (number of its first run in the whole
    series, from 0), and the ends' lengths and states. A first run that goes on from the stretch before has that
    one's number. The window sees a row a stretch, not the cells."""
    ends = [F.max("_k").alias("_n")]
    for name in ("is_null", "_len", *(("_ra", "_rz") if reset else ())):
        ends += [F.min_by(name, "_k").alias(f"{name}_a"), F.max_by(name, "_k").alias(f"{name}_z")]
    own = pieces.groupBy("_key").agg(*ends).withColumn("_whole", F.struct(*(F.col("_key")[key].alias(key) for key in keys)))
    w = Window.partitionBy("_whole").orderBy("_key._at")
    goes_on = F.lag("is_null_z").over(w) == F.col("is_null_a")
    if reset:
        goes_on = goes_on & F.coalesce(F.lag("_rz_z").over(w) == F.col("_ra_a"), F.lit(True))
    own = own.withColumn("_new", F.col("_n") + 1 - F.coalesce(goes_on, F.lit(False)).cast("int"))
    upto = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_base", upto - F.col("_n") - 1)


def _with_end_lengths(chained: DataFrame) -> DataFrame:
    """_head and _tail: whole lengths of the runs at a stretch's ends, added up over all stretches that they cross."""
    one = F.struct(F.col("_base").alias("id"), F.col("_len_a").alias("len"), F.lit(True).alias("head"))
    two = F.struct((F.col("_base") + F.col("_n")).alias("id"), F.when(F.col("_n") > 0, F.col("_len_z")).otherwise(0).alias("len"), F.lit(False).alias("head"))
    ends = chained.select("_key", "_whole", "_n", "_base", F.explode(F.array(one, two)).alias("_e"))
    ends = ends.withColumn("_total", F.sum("_e.len").over(Window.partitionBy("_whole", "_e.id")))
    return ends.groupBy("_key", "_n", "_base").agg(F.max(F.when(F.col("_e.head"), F.col("_total"))).alias("_head"), F.max(F.when(~F.col("_e.head"), F.col("_total"))).alias("_tail"))


def with_runs(df: DataFrame, *keys: str, order: str, value: str = "value", reset: str | None = None, stretch: Column | None = None) -> DataFrame:
    """is_null, run_id (from 1) and run_len: runs of null and known values in order; a
    change of ``reset`` begins a new run.

    A scan in two levels: runs are numbered within stretches of the order (years of a date, else 52
    numbers; ``stretch`` may be any column that never falls in the order), then the runs at the borders are merged on a
    row a stretch. So an endless series is spread over as many tasks as it has stretches.
    """
    cells = _cells(df, keys, _stretch_of(df, order) if stretch is None else stretch, order, value, reset)
    ends = _with_end_lengths(_chained(_pieces(cells, order, reset), keys, reset))
    own = cells.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("_key", "_k"))).join(ends, "_key")
    length = F.when(F.col("_k") == 0, F.col("_head")).when(F.col("_k") == F.col("_n"), F.col("_tail")).otherwise(F.col("_len"))
    return own.select(*df.columns, "is_null", (F.col("_base") + F.col("_k") + 1).alias("run_id"), length.alias("run_len"))


def gap_ids(df: DataFrame, *keys: str, order: str, value: str = "value") -> DataFrame:
    """Runs on rows, and an id for each run of nulls."""
    own = with_runs(df, *keys, order=order, value=value)
    return own.withColumn("gap_id", F.when(F.col("is_null"), F.concat_ws("_", *keys, F.col("run_id").cast("string"))))


def runs(df: DataFrame, *keys: str, order: str, value: str = "value", nulls_only: bool = True, reset: str | None = None, stretch: Column | None = None) -> DataFrame:
    """One row a run: keys, run_id, is_null, run_len, first and last in order. As
    ``with_runs``, without its rows: pieces of runs are aggregated in their stretch, and only those shuffled."""
    pieces = _pieces(_cells(df, keys, _stretch_of(df, order) if stretch is None else stretch, order, value, reset), order, reset)
    own = pieces.join(_chained(pieces, keys, reset).select("_key", "_base"), "_key")
    own = own.select(*(F.col("_key")[key].alias(key) for key in keys), (F.col("_base") + F.col("_k") + 1).alias("run_id"), "is_null", "_len", "first", "last")
    out = (own.where("is_null") if nulls_only else own).groupBy(*keys, "run_id", "is_null")
    return out.agg(F.sum("_len").alias("run_len"), F.min("first").alias("first"), F.max("last").alias("last"))


def fill_gaps(df: DataFrame, *keys: str, order: str = "time_seq", year: str = "year", value: str = "value", pred: str = "pred_mean", least: int = 1, most: int = 12) -> DataFrame:
    """``filled`` and ``filled_gap``: runs of ``least`` to ``most`` nulls take the
    prediction, where there is one. Runs end with the year, so the windows are on
    (key, year): a long series is spread over as many tasks as it has years. Rows that already
    lie by key aren't shuffled again."""
    w = Window.partitionBy(*keys, year).orderBy(order)
    own = df.withColumn("_null", F.col(value).isNull())
    own = own.withColumn("_b", F.coalesce(F.lag("_null").over(w) != F.col("_null"), F.lit(False)).cast("int"))
    own = own.withColumn("_k", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys, year, "_k"))
    fill = F.col("_null") & length.between(least, most) & F.col(pred).isNotNull()
    own = own.withColumn("filled_gap", fill).withColumn("filled", F.when(F.col("filled_gap"), F.col(pred)).otherwise(F.col(value)))
    return own.select(*df.columns, "filled_gap", "filled")


def data_pattern(df: DataFrame, *keys: str, year: str = "year", start: str = "start_date", value: str = "value") -> DataFrame:
    """For each (key, year): n_weeks, coverage (of 52), complete, partial and empty
    months, and the pattern: dense, moderate, sporadic or no_data."""
    seen, lack = _months_seen(year, start, value)
    out = df.groupBy(*keys, year).agg(F.count(value).alias("n_weeks"), seen.alias("_seen"), lack.alias("_lack"))
    complete, partial, empty = _kinds_of_months()
    out = out.withColumns({"n_complete": complete, "n_partial": partial, "n_empty": empty}).drop("_seen", "_lack")
    return out.withColumns({"coverage": F.col("n_weeks") / 52.0, "pattern": _pattern(F.col("n_complete"), F.col("n_partial"))})


def with_pattern(df: DataFrame, *keys: str, year: str = "year", start: str = "start_date", value: str = "value") -> DataFrame:
    """Each row with the pattern of its (key, year), as ``data_pattern`` gives it: by one window, so that
    rows that lie by key are neither aggregated nor joined."""
    seen, lack = _months_seen(year, start, value)
    w = Window.partitionBy(*keys, year)
    own = df.withColumns({"_seen": seen.over(w), "_lack": lack.over(w)})
    complete, partial, _ = _kinds_of_months()
    return own.withColumn("pattern", _pattern(complete, partial)).select(*df.columns, "pattern")


def _months_seen(year: str, start: str, value: str) -> list[Column]:
    """Two sets of months as bits: those with a known week, and those with one that isn't."""
    bit = F.call_function("shiftleft", F.lit(1), F.coalesce(cal.month_of_week(start, F.date_add(start, 6), year), F.lit(0)))
    known = F.col(value).isNotNull()
    return [F.bit_or(F.when(known, bit).otherwise(0)), F.bit_or(F.when(known, 0).otherwise(bit))]


def _kinds_of_months() -> tuple[Column, Column, Column]:
    """Numbers of complete, partial and empty months."""
    seen, lack = F.col("_seen"), F.col("_lack")
    both = seen.bitwiseAND(lack)
    return tuple(F.bit_count(x).cast("bigint") for x in (seen.bitwiseXOR(both), both, lack.bitwiseXOR(both)))


def _pattern(complete: Column, partial: Column) -> Column:
    return F.when(complete >= 6, "dense").when(complete >= 1, "moderate").when(partial > 0, "sporadic").otherwise("no_data")


def split_pattern(df: DataFrame, patterns: DataFrame | None = None, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows of regular and of sporadic (key, year)s, by their own ``pattern`` or by a table of ``patterns``."""
    if patterns is None:
        sporadic = F.col("pattern").eqNullSafe("sporadic")
        return df.where(~sporadic), df.where(sporadic)
    sporadic = patterns.where("pattern = 'sporadic'").select(*keys)
    return df.join(sporadic, list(keys), "left_anti"), df.join(sporadic, list(keys), "left_semi")


def with_code(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number of each value in sorted order, made on the distinct values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    codes = running_before(values, column, "_one", name).select(column, (F.col(name) + 1).cast("int").alias(name))
    return df.join(codes, column, "left")


def training_years(df: DataFrame, *keys: str, value: str = "value", annual: str = "annual_total") -> tuple[DataFrame, DataFrame]:
    """Rows of (key, year)s without nulls whose sum is the annual total; and the
    others, once each."""
    own = df.withColumn("_sum", strict_sum_over(value, Window.partitionBy(*keys)))
    good = F.coalesce(F.col("_sum") == F.col(annual), F.lit(False))
    return own.where(good).drop("_sum"), own.where(~good).select(*keys, annual, F.col("_sum").alias("monthly_sum")).distinct()


def attach(df: DataFrame, totals: DataFrame, *keys: str) -> DataFrame:
    return df.join(totals, list(keys), "left")


def zero_years(value: Column, annual: Column) -> Column:
    """Zero in every month of a year whose total is zero."""
    return F.when(annual == 0, F.lit(0)).otherwise(value)


def not_twelve(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n <> 12")


def coverage_view(df: DataFrame, years: list[int], *extra: str, region: str | None = None, complete: float = 1.0) -> DataFrame:
    """A row a series (and ``extra`` columns), a column a year: the resolution where coverage is complete, for one region or all."""
    own = df if region is None else df.where(F.col("region") == region)
    shown = own.withColumn("shown", F.when(F.col("prop") >= complete, F.col("t_res")))
    return shown.groupBy("series", *extra).pivot("year", years).agg(F.min("shown"))
