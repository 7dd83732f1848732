"""From source tables to canonical reports: projections, lookups, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.operators.intervals import exclude  # noqa: F401
from countloom.sources.tables import REPORT


def full_name(name: Column, unit: Column) -> Column:
    """The name alone, or name and unit."""
    return F.when(unit.isNull(), name).otherwise(F.concat_ws(", ", name, unit))


def to_report(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Projects a source onto the canonical report. ``columns`` gives the fields that
    it has (names or expressions); the name is upper-cased, all others are null."""
    own = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    own["series"] = F.upper(own["series"])
    own.setdefault("full_name", full_name(own["series"], own.get("unit1", F.lit(None).cast("string"))))
    return df.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in REPORT))


def standardise(df: DataFrame, aliases: DataFrame, *, columns: tuple[str, ...] = ("series", "full_name")) -> DataFrame:
    """Replaces names by those of an alias list (alias, name) in each column."""
    out = df
    for column in columns:
        own = aliases.select(F.col("alias").alias(column), F.col("name").alias("_name"))
        out = out.join(own, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name")
    return out.select(*df.columns)


def add_code(df: DataFrame, codes: DataFrame, *, name: str = "series", overrides: dict[str, str] | None = None, drop_unmatched: bool = False) -> DataFrame:
    """Code of each name (codes: name, iso); ``overrides`` decide first."""
    own = codes.select(F.col("name").alias(name), F.col("iso").alias("_iso"))
    code = F.col("_iso")
    for text, iso in (overrides or {}).items():
        code = F.when(F.col(name) == text, iso).otherwise(code)
    out = df.join(own, name, "left").withColumn("iso", code).drop("_iso")
    return out.where(F.col("iso").isNotNull()) if drop_unmatched else out


def name_of_code(df: DataFrame, codes: DataFrame, *, iso: str = "iso", raw: str = "raw_name") -> DataFrame:
    """Name of each code, or the raw name in capitals where the code is unknown."""
    own = codes.select(F.col("iso").alias(iso), F.col("name").alias("_name"))
    return df.join(own, iso, "left").withColumn("series", F.coalesce("_name", F.upper(raw))).drop("_name")


def unknown_names(df: DataFrame, codes: DataFrame, *, name: str = "series") -> DataFrame:
    own = codes.select(F.col("name").alias(name))
    return df.select(name).distinct().join(own, name, "left_anti")


def ambiguous_codes(df: DataFrame, *, iso: str = "iso", name: str = "series") -> DataFrame:
    """Codes with several names."""
    return df.select(iso, name).distinct().groupBy(iso).agg(F.count(F.lit(1)).alias("n_names")).where("n_names > 1")


def overwrite(df: DataFrame, column: str, when: Column, value) -> DataFrame:
    return df.withColumn(column, F.when(F.coalesce(when, F.lit(False)), F.lit(value)).otherwise(F.col(column)))


def series_year(name: Column, year: Column) -> Column:
    return F.concat_ws("_", name, year.cast("string"))


def parse_series_year(key: Column) -> tuple[Column, Column]:
    """Name (up to the first underscore) and year (last four digits) of a key."""
    return F.regexp_extract(key, r"^[^_]+", 0), F.regexp_extract(key, r"([0-9]{4})$", 1).try_cast("int")


def latitude_band(latitude: Column) -> Column:
    """Bands that hold their lower bound."""
    names = ("<-15", "[-15,-5)", "[-5,5)", "[5,15)", ">=15")
    return F.when(latitude < -15, names[0]).when(latitude < -5, names[1]).when(latitude < 5, names[2]).when(latitude < 15, names[3]).when(latitude >= 15, names[4])


def split_parent(df: DataFrame, parent: str, parts: list[str], *, name: str = "series", value: str = "value") -> DataFrame:
    """Replaces a parent's rows by one row a constituent, with a count of zero."""
    whole = df.where(~F.col(name).eqNullSafe(F.lit(parent)))
    made = df.where(F.col(name) == parent).withColumn(name, F.explode(F.array(*map(F.lit, parts)))).withColumn(value, F.lit(0).cast(df.schema[value].dataType))
    return whole.unionByName(made.select(*df.columns))


def blank_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def stack(*tables: DataFrame) -> DataFrame:
    """By name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def carry_population(population: DataFrame, *, series: str = "series", year: str = "year") -> DataFrame:
    """Repeats each series' last year for the year after."""
    last = population.groupBy(series).agg(F.max(year).alias("_last"))
    more = population.join(last, series).where(F.col(year) == F.col("_last")).withColumn(year, (F.col(year) + 1).cast(population.schema[year].dataType))
    return population.unionByName(more.select(*population.columns))


def add_population(df: DataFrame, population: DataFrame, *, series: str = "series", year: str = "year") -> DataFrame:
    return df.join(population, [series, year], "left")
