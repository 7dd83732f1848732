"""Readers and writers of report tables; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical report: one count for one place, period and source.
REPORT = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("series", T.StringType()), ("unit1", T.StringType()), ("unit2", T.StringType()), ("full_name", T.StringType()), ("iso", T.StringType()),
            ("start_date", T.DateType()), ("end_date", T.DateType()), ("year", T.IntegerType()), ("value", T.LongType()), ("definition", T.StringType()),
            ("s_res", T.StringType()), ("t_res", T.StringType()), ("source", T.StringType()), ("cat", T.StringType()),
        )
    ]
)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, *, null: str = "NA", **options) -> DataFrame:
    """Delimited text with a header; ``null`` and empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue=null, enforceSchema=True, **options)


def write_table(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: str | None = "year") -> None:
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def read_results(spark: SparkSession, paths: list[str], schema: str, *, renames: dict[str, str], optional: dict[str, str]) -> DataFrame:
    """Stacks result tables of several runs: old column names are renamed, optional
    columns that a run lacks are null."""
    out = None
    for path in paths:
        part = spark.read.csv(path, header=True)
        for old, new in renames.items():
            if old in part.columns and new not in part.columns:
                part = part.withColumnRenamed(old, new)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for name, kind in optional.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    fields = T.StructType.fromDDL(schema).fields
    return out.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields))


def clean_number(text: str | Column, *, scale: int = 1) -> Column:
    """Numbers written with blanks between digits, in units of ``scale``."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, r"[\s ]", "").try_cast("bigint") * scale


def clean_population(df: DataFrame, *, code: str, year: str, number: str, after: int = 1989) -> DataFrame:
    """iso, year, population (in persons) of rows with a code, after a year."""
    own = df.select(F.trim(code).alias("iso"), F.col(year).cast("int").alias("year"), clean_number(number, scale=1000).alias("population"))
    return own.where((F.coalesce(F.col("iso"), F.lit("")) != "") & (F.col("year") > after))


def relabel(df: DataFrame, *names: str) -> DataFrame:
    """Gives columns new names by position, where a header is wrong."""
    return df.toDF(*names)
