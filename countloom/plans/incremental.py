"""Best records kept up to date: only what has changed is selected again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.operators import rollup, select
from countloom.sources.publish import publish
from countloom.sources.shared import saved


@dataclass(frozen=True)
class Refresh:
    """best: all selected records. years: whose files have changed. n_selected: series-years that were
    selected again."""

    best: DataFrame
    years: list[int]
    n_selected: int


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """year, path, length and time of every file of a table in folders by year; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    year = F.regexp_extract("path", r"/year=([0-9]+)/", 1).cast("int")
    return files.select(year.alias("year"), F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("written"))


def digests(reports: DataFrame) -> DataFrame:
    """One row a series and year: how many reports, and two sums over hashes of theirs that don't depend on their order."""
    columns = sorted(c for c in reports.columns if c not in ("series", "year"))
    own = reports.select("series", "year", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)).alias("_h"))
    return own.groupBy("series", "year").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("a"), F.sum(F.shiftright("_h", 20)).alias("b"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def refresh_best(spark: SparkSession, reports_path: str, state: str, *, special: tuple[str, ...] = select.SPECIAL) -> Refresh:
    """Selects the best record of each series and year from reports in folders by year, and keeps the result, by year too, in
    the folder ``state``.

    The list of files shows which years have changed; only these are read. Digests of their series-years show which reports differ from
    the last run; only those are counted and selected, the others are taken over. Results equal those of a full run, as
    a choice depends on its own series and year only. The list of files is replaced last, so a run that is cut off is
    done again. Series-years and years that have gone go from the result. Nothing is written where nothing has changed.
    """
    now = saved(file_list(spark, reports_path), "files")
    old = spark.read.schema(now.schema).parquet(f"{state}/files") if _there(spark, f"{state}/files") else now.limit(0)
    changed = now.exceptAll(old).unionByName(old.exceptAll(now)).select("year").distinct()
    years = sorted(row["year"] for row in changed.collect())  # a number a folder
    first = not _there(spark, f"{state}/best")
    if not years and not first:
        return Refresh(spark.read.parquet(f"{state}/best"), [], 0)
    reports = spark.read.parquet(reports_path).where(F.col("year").isin(years))  # other folders aren't read
    made = saved(digests(reports), "digests")
    before = made.limit(0) if first else spark.read.parquet(f"{state}/digests").where(F.col("year").isin(years)).select(*made.columns)
    again = saved(made.join(before, made.columns, "left_anti").select("series", "year"), "again")
    levels = rollup.level_counts(reports.join(again, ["series", "year"], "left_semi"))
    best = select.best_records(levels, special=special)
    if not first:
        stay = spark.read.parquet(f"{state}/best").where(F.col("year").isin(years)).join(made.join(again, ["series", "year"], "left_anti"), ["series", "year"], "left_semi")
        best = stay.select(*best.columns).unionByName(best)
    gone = tuple(f"year={year}" for year in years)
    publish(saved(best, "best"), f"{state}/best", "year", emptied=gone)
    publish(made, f"{state}/digests", "year", emptied=gone)
    now.write.mode("overwrite").parquet(f"{state}/files")
    return Refresh(spark.read.parquet(f"{state}/best"), years, again.count())
