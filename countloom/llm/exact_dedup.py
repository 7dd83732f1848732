"""Operator 5: exact duplicates, screened by static binary-fuse filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm import fuse, screen
from countloom.llm.common import ascii_lower, free_names, fresh_path, saved, table, texts_of

#: Keys of one filter, and of a batch's keys that one task tests at a time, about.
KEYS_PER_FILTER = 200_000


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of doc_id, row (tells repeated rows apart), sha, key, of whole
    texts after lower-casing A-Z. ``key`` is another 64-bit hash, for the filters."""
    norm = ascii_lower(F.col("text"))
    own = texts_of(df, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"), F.xxhash64(norm).alias("key")
    )
    return saved(own, "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: sha, key, n, best (the row that would stay)."""
    return rows.groupBy("sha").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of digests with their filters, as written tables: ``groups`` (sha, key, n,
    best), ``filters`` (part, n, seed, cells) and the number of parts."""

    groups: DataFrame
    filters: DataFrame
    parts: int


def write_snapshot(rows: DataFrame, path: str) -> Snapshot:
    """Writes the snapshot of ``rows`` (as of ``digests``) to an empty folder, once; its filters
    are built here and never again."""
    spark = rows.sparkSession
    grouped(rows).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    parts = max(screen.PARTS, -(-groups.count() // KEYS_PER_FILTER))
    screen.build_filters(groups, parts).withColumn("parts", F.lit(parts)).write.parquet(f"{path}/filters")
    return read_snapshot(spark, path, parts)


def read_snapshot(spark: SparkSession, path: str, parts: int | None = None) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    if parts is None:
        first = filters.first()
        parts = first["parts"] if first else screen.PARTS
    return Snapshot(spark.read.parquet(f"{path}/groups"), filters.drop("parts"), parts)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """sha, maybe: could the snapshot hold the digest? Never wrong where false. A part's
    filter meets the batch's keys of the part in as many tasks as the batch needs."""

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(left), bool)
        for n, seed, cells in zip(right["n"], right["seed"], right["cells"]):
            maybe |= fuse.contains(left["key"].to_numpy().astype(np.uint64), n, seed, cells)
        return pd.DataFrame({"sha": left["sha"], "maybe": maybe})

    turns = max(1, -(-groups.count() // (snapshot.parts * KEYS_PER_FILTER)))
    own = groups.select(screen.part_of("key", snapshot.parts), F.pmod(F.xxhash64("sha"), F.lit(turns)).alias("turn"), "sha", "key")
    filters = snapshot.filters.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("turn", F.col("turn").cast("long"))
    return own.groupBy("part", "turn").cogroup(filters.groupBy("part", "turn")).applyInPandas(test, "sha binary, maybe boolean")


def _place(doc_id: Column, key: Column) -> Column:
    """What a row's text is fetched by: its id, or the text's hash where it has none."""
    return F.when(doc_id.isNull(), key).otherwise(F.xxhash64(doc_id))


def same_bytes(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Shas of the buckets whose two sides hold the same bytes. ``buckets``: sha, key and
    the ids of one row of either side. Texts that the screen of these rows lets pass are
    compared within their sha, first on the side of the map, so that copies of a text
    aren't shuffled. Two texts of one SHA-256 that differ end the job."""
    wanted = buckets.select("key", F.explode(F.array("old_id", "new_id")).alias("id"))
    maybe = screen.screen_of(wanted.select(_place(F.col("id"), F.col("key")).alias("key")))
    norm = ascii_lower(F.col("text"))
    fetched = texts if maybe is None else texts.where(maybe(_place(F.col("doc_id"), F.xxhash64(norm))))
    sides = fetched.select(F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"), norm.alias("norm")).groupBy("sha").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    checked = sides.join(buckets.select("sha"), "sha", "left_semi")
    return checked.where(F.when(F.col("least") == F.col("most"), True).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).cast("boolean")).select("sha")


def exact_groups(batch: DataFrame, texts: DataFrame, snapshot: Snapshot) -> DataFrame:
    """sha, n, best of all digests of the snapshot and of ``batch`` (rows as of ``digests``).
    ``texts`` (doc_id, text) holds the texts of both.

    The batch's own duplicates are grouped first, so a frequent text is one row
    from there on. The snapshot's filters screen the batch's digests; positives join the
    snapshot's buckets and have their bytes checked; all others are new.
    """
    new = saved(grouped(batch), "batch")
    positives = screened(new, snapshot).where("maybe").select("sha")
    bucket = new.join(positives, "sha").select("sha", F.col("n").alias("new_n"), F.col("best").alias("new_best")).join(snapshot.groups, "sha")
    bucket = saved(bucket.select("sha", "key", "new_n", "new_best", F.col("best.doc_id").alias("old_id"), F.col("new_best.doc_id").alias("new_id")), "buckets")
    hits = saved(bucket.join(same_bytes(bucket, texts), "sha", "left_semi").select("sha", "new_n", "new_best"), "hits")
    joined = snapshot.groups.join(hits, "sha", "left").select("sha", (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"), F.greatest("best", "new_best").alias("best"))
    fresh = new.join(hits, "sha", "left_anti").select("sha", "n", "best")
    return saved(joined.unionByName(fresh), "groups")  # so that a frequent sha's rows can be split in the join with it


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", snapshot_share: int = 2) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. One in ``snapshot_share``
    ids, by hash, is written as a snapshot, the others come as a batch (who has a snapshot
    already calls ``exact_groups`` with it). Of equal texts
    the row with the largest id stays; nulls rank lowest; of repeated rows with that
    id exactly one stays. Nulls count as empty texts, and all empty texts form one
    group. Other columns are ignored; an empty table gives an empty result.
    """
    rows = digests(df, id_col=id_col, text_col=text_col)
    in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(snapshot_share)) == 0
    snapshot = write_snapshot(rows.where(in_snapshot), fresh_path(df.sparkSession, "snapshot"))
    groups = exact_groups(rows.where(~in_snapshot), texts_of(df, id_col, text_col), snapshot)
    return rows.join(groups, "sha").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.struct("doc_id", "row") == F.col("best")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names.

    One row of each group of equal texts stays, that with the largest id; nulls rank
    lowest. Nulls count as empty texts; of repeated rows, and of rows without an id in a
    group that has no other, one stays, any where their other columns differ. An empty
    table gives an empty result.
    """
    gone_id, gone_sha, own_sha = free_names(df, "gone_id", "gone_sha", "own_sha")
    found = exact_dedup(df, id_col=id_col, text_col=text_col)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(gone_id), F.unhex("text_sha256").alias(gone_sha))
    gone = saved(gone.distinct(), "gone")
    own_id = df[id_col].cast("long")
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(df[text_col].cast("string"), F.lit(""))).cast("binary"), 256))
    condition = own_id.eqNullSafe(gone[gone_id]) & (sha == gone[gone_sha])
    out = screen.without(df, gone, condition, F.xxhash64(own_id), F.xxhash64(gone_id))
    if not df.groupBy(own_id).count().where("count > 1").isEmpty():  # repeated rows: one of each
        out = out.withColumn(own_sha, sha).dropDuplicates([id_col, own_sha]).drop(own_sha)
    return out


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
