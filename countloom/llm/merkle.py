"""Operator 13: a Merkle manifest of a dataset, and its proofs by octopus multiproofs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.functions.numbering import running_before
from countloom.llm.common import bounded_batches, saved, table

#: Nodes of a run, levels that one task builds of a block of FAN ** LEVELS nodes, and
#: leaves of a segment whose proofs one task expands.
FAN, LEVELS, SEGMENT = 3, 7, 4096
#: The tree over the groups' own roots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def parent(run: list[bytes]) -> bytes:
    """H of a run: sha256 of its digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def leaf_of(fields: list[Column]) -> Column:
    """H of a row's fields as binary: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(field.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass(frozen=True)
class Manifest:
    """leaves: doc_id, leaf, presented, tree, pos, n (leaves of the tree), at (position among
    all leaves). nodes: tree, level, idx, hash of all levels above the leaves; the tree -1
    stands over the groups' roots, its level 0 included. trees: tree, grp, n. ``root`` is
    None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: bytes | None


def _in_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and rows of each group of a sorted stream; the first ``n_keys`` columns are the key.
    At most one group and one batch are held."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _stream(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """``step(key, rows)`` gives tuples for each group, which are handed on in batches."""
    bounded_batches(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    n_keys = len(keys)

    def run(batches):
        out: list[tuple] = []
        for key, rows in _in_groups(batches, n_keys):
            out.extend(step(key, rows))
            if len(out) >= 8192:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), arrow_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), arrow_schema)

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrow_schema = pa.schema([(part.split()[0], types[part.split()[1]]) for part in schema.split(", ")])
    own = df.select(*keys, *(c for c in df.columns if c not in keys))
    return own.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _raised(nodes: DataFrame, level: int) -> DataFrame:
    """Up to ``LEVELS`` further levels over nodes (tree, idx, n, hash) of one level: tree, level,
    idx, n (nodes of the tree in that level), hash, top (the only one left)."""

    def build(key: tuple, rows: list[tuple]) -> list[tuple]:
        tree, block = key
        n, out = rows[0][1], []
        first, own = rows[0][0], [row[2] for row in rows]
        for up in range(1, LEVELS + 1):
            if n == 1:
                break
            own = [parent(own[k : k + FAN]) for k in range(0, len(own), FAN)]
            first, n = first // FAN, -(-n // FAN)
            out.extend((tree, level + up, first + k, n, digest, n == 1) for k, digest in enumerate(own))
        return out

    blocks = nodes.select("tree", F.expr(f"idx div {FAN**LEVELS}").alias("block"), "idx", "n", "hash")
    return _stream(blocks, ["tree", "block"], ["idx"], build, "tree long, level int, idx long, n long, hash binary, top boolean")


def _all_levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``nodes``, of trees of at most ``most`` nodes, a table for each pass."""
    out, level = [], 0
    while most > 1:
        made = saved(_raised(nodes, level), "nodes")
        out.append(made)
        level += LEVELS
        most = -(-most // FAN**LEVELS)
        nodes = made.where((F.col("level") == level) & ~F.col("top")).select("tree", "idx", "n", "hash")
    return out


def build(df: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", presented: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``df``: a tree of its leaves for each group, and one over the groups' roots.

    Leaves ascend by id, null first; rows with equal ids by their leaf, so repeated rows keep one leaf
    each and any order of them gives the same root. Null groups are a group of their own, before all
    others, which go by their UTF-8 bytes. Null fields, empty and very long texts are hashed whole; an empty
    table has no root. Only ``fields`` are read, whatever other columns there are. ``presented`` replaces
    fields to get the leaf that a holder of the row would show (column presented).

    Rows are numbered over ranges of (group, id, leaf, input split), which cut a large group, an id that
    repeats and copies alike. Blocks of 3 ** 7 nodes are raised seven levels in one task.
    """
    shown = {name: F.col(name) for name in fields} | (presented or {})
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first
    own = df.select(
        group.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf_of([F.col(name) for name in fields]).alias("leaf"),
        leaf_of([shown[name] for name in fields]).alias("presented"), F.spark_partition_id().alias("split"),
    )
    own = saved(own, "leaves")  # texts are hashed once, not again for the ranges
    order = ["grp", F.col("doc_id").asc_nulls_first(), "leaf", "split"]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    own = own.select("grp", "doc_id", "leaf", "presented", F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("local"))
    own = saved(own, "ranges")
    cuts = saved(own.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("_n"), F.min("local").alias("_local")), "cuts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = cuts.groupBy("part").agg(F.sum("_n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cuts = cuts.join(parts, "part")
    groups = cuts.groupBy("grp").agg(F.sum("_n").alias("n"), F.min(F.col("_before") + F.col("_local")).alias("first"))
    trees = saved(running_before(groups.withColumn("_one", F.lit(1)), "first", "_one", "tree").select(F.col("tree").cast("long"), "grp", "n", "first"), "trees")
    n_trees, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = cuts.join(trees, "grp").select("part", "grp", "tree", "n", "first", "_before")
    leaves = own.join(placed, ["part", "grp"]).withColumn("at", F.col("_before") + F.col("local"))
    leaves = saved(leaves.select("doc_id", "leaf", "presented", "tree", (F.col("at") - F.col("first")).alias("pos"), "n", "at"), "leaves")

    ground = leaves.select("tree", F.col("pos").alias("idx"), "n", F.col("leaf").alias("hash"))
    levels = _all_levels(ground, most)
    roots = ground.where("n = 1").select("tree", "hash")  # a lone leaf is its group's root
    for made in levels:
        roots = roots.unionByName(made.where("top").select("tree", "hash"))
    tops = saved(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "hash", F.lit(n_trees == 1).alias("top")), "roots")
    above = _all_levels(tops.select("tree", "idx", "n", "hash"), n_trees)
    nodes = tops
    for made in (*levels, *above):
        nodes = nodes.unionByName(made)
    last = (above[-1] if above else tops).where("top").select("hash").first()  # one row
    return Manifest(leaves, nodes.select("tree", "level", "idx", "hash"), trees.select("tree", "grp", "n"), n_trees, bytes(last[0]) if last else None)


def missing_of(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """(level, idx) of the least set of nodes that prove the leaves ``first`` to ``last`` of
    ``n``, all of them at once: at each level the others of the runs at both ends. What
    those leaves give themselves isn't among them."""
    out, level = [], 0
    while n > 1:
        out.extend((level, idx) for idx in range(first - first % FAN, first))
        out.extend((level, idx) for idx in range(last + 1, min(last - last % FAN + FAN, n)))
        first, last, n, level = first // FAN, last // FAN, -(-n // FAN), level + 1
    return out


def _rows_by_level(first: int, own: list[bytes], n: int, fetched: dict[tuple[int, int], bytes]) -> list[tuple[int, list[bytes]]]:
    """For each level the nodes of all runs that the leaves touch, with the index of the
    first: own ones derived, each once, the others from ``fetched``. The last level is
    the root."""
    out, level = [], 0
    while n > 1:
        start = first - first % FAN
        last = first + len(own) - 1
        end = min(last - last % FAN + FAN, n)
        row = [fetched[level, idx] for idx in range(start, first)] + own + [fetched[level, idx] for idx in range(last + 1, end)]
        out.append((start, row))
        own = [parent(row[k : k + FAN]) for k in range(0, len(row), FAN)]
        first, n, level = start // FAN, -(-n // FAN), level + 1
    out.append((0, own))
    return out


def _climb(pos: int, digest: bytes, levels: list[tuple[int, list[bytes]]], siblings: list[bytes]) -> bytes:
    """Folds ``digest`` at ``pos`` with the others of its runs up to the root, and
    appends these to ``siblings``."""
    for start, row in levels[:-1]:
        at = pos - start
        low = at - at % FAN
        left, right = row[low:at], row[at + 1 : low + FAN]
        siblings += left
        siblings += right
        digest, pos = parent([*left, digest, *right]), pos // FAN
    return digest


def proofs(manifest: Manifest) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof (the siblings' digests, 32 bytes each, level
    by level and from left to right, through the group's root to the root), folded_root (from the
    presented leaf and the siblings) and verified (it is the manifest's root). Digests are binary.

    Segments of ``SEGMENT`` leaves in a row are proved together: each derives the coordinates
    of the nodes that it lacks from its first and last leaf, they are fetched in one
    join, shared interior nodes are derived once, and each leaf's own proof is read from them. A segment
    holds whole small groups and slices of large ones, so no group is one task.
    """
    root, n_trees = manifest.root, manifest.n_trees
    leaves = manifest.leaves.withColumn("seg", F.expr(f"at div {SEGMENT}"))

    def lacking(key: tuple, rows: list[tuple]) -> list[tuple]:
        out = [(*key, tree, level, idx) for tree, first, last, n in rows for level, idx in missing_of(first, last, n)]
        trees = [row[0] for row in rows]  # groups in a row
        return out + [(*key, TOP, level, idx) for level, idx in missing_of(min(trees), max(trees), n_trees)]

    spans = leaves.groupBy("seg", "tree").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"))
    lacks = _stream(spans, ["seg"], ["tree"], lacking, "seg long, tree long, level int, idx long")
    edge = F.pmod("at", F.lit(SEGMENT))
    border = leaves.where((edge < FAN - 1) | (edge > SEGMENT - FAN))  # other leaves are never lacking
    nodes = manifest.nodes.unionByName(border.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash")))
    fetched = lacks.join(nodes, ["tree", "level", "idx"])

    def expand(key: tuple, rows: list[tuple]) -> list[tuple]:
        lent: dict[int, dict[tuple[int, int], bytes]] = {}
        held: dict[int, list[tuple]] = {}
        for at, tree, level, idx, digest, doc_id, presented, n in rows:
            if at < 0:
                lent.setdefault(tree, {})[level, idx] = digest
            else:
                held.setdefault(tree, []).append((idx, digest, doc_id, presented, n))
        own = {tree: _rows_by_level(part[0][0], [row[1] for row in part], part[0][4], lent.get(tree, {})) for tree, part in held.items()}
        top = _rows_by_level(min(own), [own[tree][-1][1][0] for tree in sorted(own)], n_trees, lent.get(TOP, {}))
        out = []
        for tree, part in held.items():
            subroot = own[tree][-1][1][0]
            for pos, leaf, doc_id, presented, _ in part:
                siblings: list[bytes] = []
                folded = _climb(tree, _climb(pos, presented, own[tree], siblings), top, siblings)
                out.append((doc_id, leaf, subroot, root, b"".join(siblings), folded, folded == root))
        return out

    a = fetched.select("seg", F.lit(-1).cast("long").alias("at"), "tree", "level", "idx", "hash", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("presented"), F.lit(0).cast("long").alias("n"))
    b = leaves.select("seg", "at", "tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "doc_id", "presented", "n")
    schema = "doc_id long, leaf binary, subroot binary, root binary, proof binary, folded_root binary, verified boolean"
    return _stream(a.unionByName(b), ["seg"], ["at"], expand, schema)


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    shown = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    made = proofs(build(table(spark, sf_dir, "documents"), presented=shown))
    return made.select("doc_id", _hex("leaf"), _hex("subroot"), _hex("root"), F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), _hex("folded_root"), "verified")


_ZEROS = ", ".join("0" * 8)
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(name) for name in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _fold_sql(own: str, at: str) -> str:
    return f"sha256({' || '.join(f'CASE WHEN {at} % 3 = {k} THEN {own} ELSE coalesce(h[{k + 1}], {chr(39) * 2}) END' for k in range(3))})"


#: crc32 bit by bit; trees level by level; proofs and folds from the runs of each level.
OP13_SQL = f"""WITH RECURSIVE bytes AS (SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS b FROM documents),
  marked AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, d: list_reduce([xor(c, d), {_ZEROS}], lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295) % 2 = 0, false) AS hit FROM bytes),
  shown AS (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS seen FROM marked),
  hashed AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("seen")} AS presented FROM shown),
  placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf, presented) AS k FROM hashed),
  low AS (SELECT tree, 0 AS level, pos AS idx, n, leaf AS hash FROM placed
    UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n),
  subs AS (SELECT tree, hash AS subroot, (SELECT count(DISTINCT tree) FROM placed) AS m FROM low WHERE n = 1),
  high AS (SELECT -1::BIGINT AS tree, 0 AS level, tree AS idx, m AS n, subroot AS hash FROM subs
    UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY tree, level, idx // 3, n),
  runs AS (SELECT tree, level, idx // 3 AS run, n, list(hash ORDER BY idx) AS h FROM (SELECT * FROM low UNION ALL SELECT * FROM high) WHERE n > 1 GROUP BY ALL),
  a AS (SELECT k, tree, pos AS idx, 0 AS level, presented AS own, '' AS proof, tree AS src FROM placed
    UNION ALL SELECT k, a.tree, idx // 3, a.level + 1, {_fold_sql("own", "idx")}, proof || {" || ".join(f"CASE WHEN idx % 3 = {k} THEN '' ELSE coalesce(h[{k + 1}], '') END" for k in range(3))}, src FROM a JOIN runs r ON r.tree = a.tree AND r.level = a.level AND r.run = a.idx // 3),
  mid AS (SELECT k, max_by(own, level) AS own, max_by(proof, level) AS proof, any_value(src) AS src FROM a GROUP BY k),
  c AS (SELECT k, src AS idx, 0 AS level, own, proof FROM mid
    UNION ALL SELECT k, idx // 3, c.level + 1, {_fold_sql("own", "idx")}, proof || {" || ".join(f"CASE WHEN idx % 3 = {k} THEN '' ELSE coalesce(h[{k + 1}], '') END" for k in range(3))} FROM c JOIN runs r ON r.tree = -1 AND r.level = c.level AND r.run = c.idx // 3),
  done AS (SELECT k, max_by(own, level) AS folded_root, max_by(proof, level) AS proof FROM c GROUP BY k),
  top AS (SELECT hash AS root FROM high WHERE n = 1)
  SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
  FROM placed JOIN done USING (k) JOIN subs USING (tree) CROSS JOIN top"""
