"""Tables that are checked as they are written and replaced partition by partition."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from countloom.sources.shared import fresh_path


class CheckFailed(ValueError):
    """Rows that break a rule, by its name."""

    def __init__(self, table: str, broken: dict[str, int]):
        super().__init__(f"{table}: " + ", ".join(f"{name} in {n} rows" for name, n in broken.items()))
        self.broken = broken


def repeats(*key: str) -> Column:
    """True for rows whose key is there more than once."""
    return F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1


def _written(df: DataFrame, table: str, checks: dict[str, Column], write) -> int:
    """Writes ``df`` with ``write`` and counts, in the same job, the rows that a check is true for. Gives the
    number of rows, or an error."""
    names = [f"_check{k}" for k in range(len(checks))]
    flagged = df.withColumns(dict(zip(names, checks.values()))) if checks else df
    seen = Observation(f"{table}-{uuid.uuid4().hex}")
    write(flagged.observe(seen, F.count(F.lit(1)).alias("n"), *(F.count_if(name).alias(name) for name in names)).drop(*names))
    found = seen.get
    broken = {check: found[name] for check, name in zip(checks, names) if found[name]}
    if broken:
        raise CheckFailed(table, broken)
    return found["n"]


def checked(df: DataFrame, name: str, **checks: Column) -> DataFrame:
    """As ``shared.saved``, and an error if a check is true for any row. The checks (conditions, windows among them) are
    evaluated by the job that writes: they cost no job of their own, and nobody reads a table that failed."""
    path = fresh_path(df.sparkSession, name)
    _written(df, name, checks, lambda own: own.write.parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def publish(df: DataFrame, path: str, *by: str, emptied: tuple[str, ...] = (), **checks: Column) -> int:
    """Replaces the partitions (of the columns ``by``) that ``df`` has rows for, and leaves all others, and their
    files, as they are; those named in ``emptied`` (such as ``year=2003``) go if ``df`` has no rows for them. Gives the
    number of rows.

    The rows are written beside the table first. A job that fails, or a check that is true for a row, leaves the
    table untouched. Then a manifest names the partitions to replace, and they are moved into their places one by one; if
    that is cut off, ``recover`` ends it, and until then no staged partition is lost. One writer at a time.
    """
    spark = df.sparkSession
    recover(spark, path)
    p, fs = _files(spark, path)
    stage = f"{path}/_stage-{uuid.uuid4().hex}"
    try:
        n = _written(df, path, checks, lambda own: own.write.partitionBy(*by).parquet(stage))
    except BaseException:
        fs.delete(p(stage), True)
        raise
    parts = sorted(_partitions(spark, stage, len(by)))
    out = fs.create(p(f"{stage}/manifest.part"), True)
    out.write(bytearray(json.dumps({"partitions": parts, "emptied": sorted(set(emptied) - set(parts))}).encode()))
    out.close()
    fs.rename(p(f"{stage}/manifest.part"), p(f"{stage}/manifest.json"))  # from here on the replacement is decided
    _moved(spark, path, stage, parts, sorted(set(emptied) - set(parts)))
    return n


def _partitions(spark: SparkSession, root: str, depth: int) -> list[str]:
    p, fs = _files(spark, root)
    found = [""]
    for _ in range(depth if fs.exists(p(root)) else 0):
        found = [f"{part}/{status.getPath().getName()}" for part in found for status in fs.listStatus(p(root + part)) if status.isDirectory() and "=" in status.getPath().getName()]
    return [part.lstrip("/") for part in found]


def _moved(spark: SparkSession, path: str, stage: str, parts: list[str], emptied: list[str]) -> None:
    p, fs = _files(spark, path)
    for part in emptied:
        fs.delete(p(f"{path}/{part}"), True)
    for part in parts:
        source, target = p(f"{stage}/{part}"), p(f"{path}/{part}")
        if fs.exists(source):  # else it was moved before
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"{part} can't be moved into its place; call recover")
    fs.delete(p(stage), True)


def recover(spark: SparkSession, path: str) -> list[str]:
    """Ends a replacement that was cut off after its manifest was written, and drops what was
    staged without one. Gives the stages that were ended."""
    p, fs = _files(spark, path)
    ended = []
    if not fs.exists(p(path)):
        return ended
    for status in fs.listStatus(p(path)):
        name = status.getPath().getName()
        if not name.startswith("_stage-"):
            continue
        stage = f"{path}/{name}"
        if fs.exists(p(f"{stage}/manifest.json")):
            text = "\n".join(row.value for row in spark.read.text(f"{stage}/manifest.json", wholetext=True).collect())  # one file
            manifest = json.loads(text)
            _moved(spark, path, stage, manifest["partitions"], manifest["emptied"])
            ended.append(name)
        else:
            fs.delete(p(stage), True)
    return ended
