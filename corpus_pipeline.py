"""The corpus pipeline: five stages, each calling one operator of ``countloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countloom.llm.bpe import round_trip
from countloom.llm.common import saved, table
from countloom.llm.decontaminate import drop_copies
from countloom.llm.exact_dedup import drop_exact
from countloom.llm.quality import fit, keep_good
from countloom.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, fitted on labelled ones, doesn't reject, with all their columns.

    Null and empty texts are scored like any other, so they go if the ranking rejects an empty text.
    Repeated rows, and rows without an id, are each judged by their text; rows with equal scores
    fare alike. Very long texts count whole. An empty table stays empty; without labels all stay.
    """
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z the row with the largest id, with all its columns.

    Nulls count as empty texts, all of which are one group. Of rows that share the largest id, or
    have none, one stays. Very long texts count whole. An empty table stays empty.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near-duplicates the row with the smallest id, with all its columns.

    Texts without words, nulls among them, have fingerprint zero and link like any other. Null
    ids rank last; of rows that share the smallest id one stays. Very long texts count whole. An empty
    table stays empty.
    """
    return drop_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark passage, with all their columns.

    Null and empty texts copy nothing and stay; repeated rows, and rows without an id, are each
    judged by their text. Very long texts are searched whole. An empty table stays empty; an
    empty benchmark drops nothing.
    """
    return drop_copies(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, a row a document.

    Null and empty texts have no tokens. Null ids stay null, repeated rows give repeated results,
    other columns are left out. Very long texts are encoded whole. An empty table stays empty.
    """
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("bpe", encoded)]

#: Ranking, fingerprints, alignment and BPE aren't SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
