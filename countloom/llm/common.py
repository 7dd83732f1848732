"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.shared import fresh_path, saved  # noqa: F401

#: Bytes of text that one Arrow batch may carry to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that long texts don't fill a worker. The
    setting holds for the session, as its plans read it when they run; a smaller one that the
    user has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(name))
    except ValueError:  # none, or with a unit
        now = 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch (None: no rows)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that a text operator reads; a null text counts as empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(column):
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
