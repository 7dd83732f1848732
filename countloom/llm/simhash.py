"""Operator 3: near-duplicates by SimHash and an index of fingerprint bytes."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import free_names, map_batches, saved, table, texts_of
from countloom.llm.components import connected_components
from countloom.llm.screen import without

BITS, BYTES = 3, 8
#: Fingerprints that differ in three bits at most share at least this many bytes.
LEAST_SHARED = BYTES - BITS
#: Four positions whose numbers xor to zero. Of any five of the eight positions,
#: some four are such a quad, so two linked fingerprints share one quad's bytes.
QUADS = [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
#: Postings of one list are compared in blocks of this many.
BLOCK = 2048


def fingerprint_of(text: str) -> int:
    """SimHash of 64 bits over the text's 3-word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long) for each row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint_of(text) for text in batch.column(2).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    own = texts_of(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(own, step, "doc_id long, text_hash long, fp long")


def _byte_at(fp: Column, position: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, position * 8).bitwiseAND(F.lit(255)).cast("int")


def _quad_mask(quad: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in quad)
    return mask - (1 << 64) if mask >> 63 else mask


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, least member) of the linked groups among distinct fingerprints:
    one edge a member at most, however many pairs are linked."""
    n = len(values)
    root = np.arange(n)
    for at in range(0, n, 256):
        i, j = np.nonzero(np.bitwise_count(values[at : at + 256, None] ^ values[None, :]) <= BITS)
        i = i + at
        keep = i < j
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
    out = []
    for k in range(n):
        r = k
        while root[r] != r:
            r = root[r]
        if r != k:
            out.append((int(values[k]), int(values[r])))
    return out


def tallied(unique: DataFrame) -> DataFrame:
    """fp, quad, part, fifth, n: the index's postings that can hold a pair with a tally of
    ``LEAST_SHARED`` positional bytes, with the length of their list.

    A list of the first level has four positions with their bytes (a quad), so its
    members have a tally of four; lists of one member end here. Each further position at which two
    members share the byte adds one to their tally. The least tally is reached with the first of
    them, so the lists of the second level, a quad and a fifth position with its byte, hold just the
    pairs whose tally is enough, and pairs of four shared bytes are never made.
    """
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("quad"), F.col("fp").bitwiseAND(F.lit(_quad_mask(q))).alias("part")) for k, q in enumerate(QUADS)))).alias("k")
    postings = unique.select("fp", keys).select("fp", "k.quad", "k.part")
    shared = postings.groupBy("quad", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("quad", "part")
    others = F.array(*(F.array(*(F.lit(p) for p in range(BYTES) if p not in q)) for q in QUADS))
    fifth = F.transform(F.element_at(others, F.col("quad") + 1), lambda p: p * 256 + _byte_at(F.col("fp"), p))
    own = saved(postings.join(shared, ["quad", "part"]).select("fp", "quad", "part", F.explode(fifth).alias("fifth")), "postings")
    lists = own.groupBy("quad", "part", "fifth").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(lists, ["quad", "part", "fifth"])


def links(unique: DataFrame) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) whose components are
    those of all pairs with at most three differing bits.

    Linked pairs differ in three bytes at most, so they have a tally of five shared positional
    bytes and are in one list of ``tallied``; there their bits are counted. A long list is dealt
    into blocks, and every pair of blocks is its own group, so no posting is left out
    and no group passes two blocks. A group returns a forest, not its pairs.
    """
    own = tallied(unique)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = own.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    groups = own.groupBy("quad", "part", "fifth", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        pair = starts[sizes == 2]  # the most frequent case, all at once
        a, b = flat[pair], flat[pair + 1]
        near = np.bitwise_count(a ^ b) <= BITS
        edges: list[tuple[int, int]] = list(zip(a[near].tolist(), b[near].tolist()))
        for k in np.flatnonzero(sizes > 2):
            edges += forest(np.sort(flat[starts[k] : ends[k]]))
        if not edges:
            return None
        out = np.array(edges, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

    return map_batches(groups.where(F.size("fps") > 1).select("fps"), step, "a long, b long")


def _rank():
    """Orders the rows of a component: smallest id first, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def _components(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fingerprints`` with ``best``, the first row of their component."""
    unique = saved(rows.groupBy("fp").agg(F.min(_rank()).alias("least")), "unique")
    roots = saved(connected_components(links(unique)), "roots")
    members = roots.join(unique, F.col("node") == F.col("fp")).select("fp", "root", "least")
    reached = saved(members.join(members.groupBy("root").agg(F.min("least").alias("best")), "root").select("fp", "best"), "reached")
    return rows.join(unique.join(reached, "fp", "left").select("fp", F.coalesce("best", "least").alias("best")), "fp")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    Rows with equal fingerprints are one node of the graph, so copies cost nothing
    beyond their own row. Nulls and texts without words have fingerprint zero and
    link like any other. component_id is the smallest id reachable, nulls aside;
    it is null if all ids of a component are. Repeated rows give repeated results;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = _components(saved(fingerprints(df, id_col=id_col, text_col=text_col), "fingerprints"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def drop_near(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each component, with all columns, whatever their names: that with
    the smallest id; null ids rank last. Of several texts with that id, and of repeated rows, one
    stays, any where their other columns differ. Nulls count as empty texts; an empty table
    gives an empty result. Very long texts are taken whole."""
    near_id, near_hash, own_text = free_names(df, "near_id", "near_hash", "own_text")
    prints = saved(fingerprints(df, id_col=id_col, text_col=text_col), "fingerprints")
    gone = _components(prints).where(~_rank().eqNullSafe(F.col("best")))
    gone = saved(gone.select(F.col("doc_id").alias(near_id), F.col("text_hash").alias(near_hash)).distinct(), "gone")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    own_id = df[id_col].cast("long")
    condition = own_id.eqNullSafe(gone[near_id]) & (F.xxhash64(text) == gone[near_hash])
    out = without(df, gone, condition, F.xxhash64(own_id), F.xxhash64(near_id))
    if not prints.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():  # repeated rows: one of each
        out = out.withColumn(own_text, text).dropDuplicates([id_col, own_text]).drop(own_text)
    return out


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
