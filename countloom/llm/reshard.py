"""Operator 9: resharding by minimum-cost flow, so that the fewest bytes move."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom.llm.common import fresh_path, saved, table

SHARDS, OLD_SHARDS = 24, 16
#: Bytes of a block, the unit of transfers, and blocks of an old shard at least.
BLOCK_BYTES, LEAST_BLOCKS = 32 << 20, 64
#: Groups of equal texts above this share of a shard, in bytes or rows, are placed and numbered one by
#: one; there are fewer than shards / LARGE_SHARE of either.
LARGE_SHARE = 0.05


def least_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, in total all of ``supply``, that
    moves the fewest bytes; staying in the shard of the same number is free.

    Successive shortest paths with potentials, on a graph of a node a shard. The
    capacities must hold the supply.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, room, cost, place of the reverse edge

    def link(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, size in enumerate(supply):
        link(source, i, size, 0)
        for j in range(m):
            link(i, n + j, size, int(i != j))
    for j, room in enumerate(capacity):
        link(n + j, sink, room, 0)
    height = [0] * len(graph)
    left = sum(supply)
    while left:
        far: list[float] = [float("inf")] * len(graph)
        came: list[tuple[int, int]] = [(-1, -1)] * len(graph)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room and (e := d + cost + height[a] - height[b]) < far[b]:
                    far[b], came[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        if far[sink] == float("inf"):
            raise ValueError("the capacities don't hold the supply")
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far)]
        push, b = left, sink
        while b != source:
            a, k = came[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = came[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return {(i, edge[0] - n): supply[i] - edge[1] for i in range(n) for edge in graph[i] if n <= edge[0] < n + m and supply[i] - edge[1] > 0}


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def sized(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, size, text_hash: what placement goes by."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", (F.octet_length("text") + F.lit(8)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash")
    )


def whole_places(groups: list[tuple[int, int, int]], capacity: list[int]) -> dict[int, int]:
    """Shards of large groups (text_hash, old shard, bytes) that stay whole, the largest first:
    where they are if there is room, else where most room is. A group that passes the room
    of every shard has no place here: it has to be split."""
    room, out = list(capacity), {}
    for text_hash, old, size in sorted(groups, key=lambda g: (-g[2], g[0])):
        best = old if old < len(room) and room[old] >= size else max(range(len(room)), key=lambda k: (room[k], -k))
        if room[best] >= size:
            room[best] -= size
            out[text_hash] = best
    return out


class Placement:
    """Which shard a row goes to, as column expressions: no join with the texts.

    ``rows``: doc_id, size, text_hash and old, the number of the row's shard so far. An old shard is
    a sequence of blocks, a block a sequence of units in order of (text_hash, part). A unit is the rows of
    an old shard with one text. Large groups of equal texts are placed whole, each by itself, as long as a
    shard has room; what passes that is split into parts. The flow then cuts every sequence
    at a few places; each cut is a key, and a row's shard follows from comparing its key with
    the cuts.

    ``least_moved`` is the flow's cost: the fewest bytes of what isn't placed whole that can change shards.
    """

    def __init__(self, rows: DataFrame, shards: int, old_shards: int):
        self.shards, self.old_shards = shards, old_shards
        groups = saved(rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("old").alias("old")), "groups")
        totals = groups.agg(F.sum("bytes"), F.sum("n")).first()
        self.total, n_rows = int(totals[0] or 0), int(totals[1] or 0)
        self.blocks = max(LEAST_BLOCKS, -(-self.total // (BLOCK_BYTES * old_shards)))
        most, most_rows = max(1, int(LARGE_SHARE * self.total / shards)), max(1, int(LARGE_SHARE * n_rows / shards))
        large = groups.where((F.col("bytes") > most) | (F.col("n") > most_rows)).collect()  # a bounded number: see LARGE_SHARE
        capacity = even_capacities(self.total, shards)
        heavy = [(r["text_hash"], r["old"], r["bytes"]) for r in large if r["bytes"] > most]
        self.whole = whole_places(heavy, capacity)
        self.split = {text_hash: -(-size // most) for text_hash, _, size in heavy if text_hash not in self.whole}
        self.turns = {r["text_hash"]: -(-r["n"] // most_rows) for r in large if r["n"] > most_rows}
        self.rows = self._keyed(rows)
        units = saved(self.rows.where(F.col("fixed").isNull()).groupBy("old", "block", "text_hash", "part").agg(F.sum("size").alias("bytes")), "units")
        blocks = units.groupBy("old", "block").agg(F.sum("bytes").alias("bytes"))
        before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = saved(blocks.select("old", "block", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before")), "blocks")
        supply = {row["old"]: int(row["bytes"]) for row in blocks.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}  # a row an old shard
        room = list(capacity)
        for text_hash, _, size in heavy:
            if text_hash in self.whole:
                room[self.whole[text_hash]] -= size
        self.flow = least_cost_flow([supply.get(k, 0) for k in range(old_shards)], room)
        self.least_moved = sum(n for (a, b), n in self.flow.items() if a != b)
        self.cuts = self._cuts(units, blocks)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        def listed(values: dict[int, int]) -> Column:
            if not values:
                return F.lit(None).cast("int")
            return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("text_hash")].cast("int")

        own = F.xxhash64("doc_id")
        return rows.withColumns(
            {
                "block": F.pmod(F.shiftright("text_hash", 16), F.lit(self.blocks)).cast("int"),
                "part": F.coalesce(F.pmod(own, listed(self.split)), F.lit(0)).cast("int"),
                "fixed": listed(self.whole),
                "turn": F.coalesce(F.pmod(F.shiftright(own, 20), listed(self.turns)), F.lit(0)).cast("int"),
            }
        )

    def _cuts(self, units: DataFrame, blocks: DataFrame) -> dict[int, list[tuple[tuple[int, int, int], int]]]:
        """For each old shard its pieces in order: (first key that is beyond the piece,
        shard). A unit belongs to the piece that holds its middle byte."""
        pieces = {k: [(dest, n) for (old, dest), n in sorted(self.flow.items(), key=lambda x: (x[0][0] != x[0][1], x[0])) if old == k] for k in range(self.old_shards)}
        bounds = []
        for old, own in pieces.items():
            at = 0
            for k, (_, n) in enumerate(own[:-1]):
                at += n
                bounds.append((old, k, at))
        cuts = {old: [((self.blocks, 0, 0), own[-1][0])] if own else [] for old, own in pieces.items()}
        if not bounds:
            return cuts
        spark = units.sparkSession
        wanted = spark.createDataFrame(bounds, "old int, cut int, at long")  # fewer than old and new shards together
        struck = blocks.join(F.broadcast(wanted), "old").where("before <= at and at < before + bytes").select("old", "block", "cut", F.col("at") - F.col("before"), "before")
        struck = struck.toDF("old", "block", "cut", "inside", "before")
        order = Window.partitionBy("old", "block", "cut").orderBy("text_hash", "part").rowsBetween(Window.unboundedPreceding, 0)
        inside = units.join(F.broadcast(struck), ["old", "block"]).withColumn("upto", F.sum("bytes").over(order))
        beyond = inside.where(F.col("upto") - F.col("bytes") / 2 > F.col("inside")).groupBy("old", "cut").agg(F.min(F.struct("block", "text_hash", "part")).alias("key"))
        rest = struck.join(beyond, ["old", "cut"], "left").select("old", "cut", "block", "key").collect()
        keys = {(r["old"], r["cut"]): tuple(r["key"]) if r["key"] is not None else (r["block"] + 1, -(1 << 63), 0) for r in rest}
        for old, own in pieces.items():
            cuts[old] = [(keys[old, k], dest) for k, (dest, _) in enumerate(own[:-1])] + cuts[old]
        return cuts

    def shard(self) -> Column:
        chosen = F.lit(None).cast("int")
        for old, pieces in self.cuts.items():
            if not pieces:
                continue
            inner = F.lit(pieces[-1][1])
            for (block, text_hash, part), dest in reversed(pieces[:-1]):
                here = (F.col("block") < block) | (
                    (F.col("block") == block) & ((F.col("text_hash") < text_hash) | ((F.col("text_hash") == text_hash) & (F.col("part") < part)))
                )
                inner = F.when(here, dest).otherwise(inner)
            chosen = F.when(F.col("old") == old, inner).otherwise(chosen)
        return F.coalesce("fixed", chosen)


RUN = ["shard", "old", "block", "part", "turn"]
COLUMNS = ["doc_id", "text", "size", "text_hash", "old", "block", "part", "turn", "split", "shard"]


def _moves(rows: DataFrame, shards: int, old_shards: int) -> tuple[DataFrame, Placement]:
    placement = Placement(rows, shards, old_shards)
    placed = placement.rows.withColumns({"shard": placement.shard(), "split": F.col("text_hash").isin(*placement.split) if placement.split else F.lit(False)})
    return placed.select(*COLUMNS), placement


def reshard(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """doc_id, text, size, text_hash, old, block, part, turn, split, shard of every row in its new shard.

    For a table that has no shards yet: the old layout deals texts to ``old_shards`` by hash (a
    sharded folder is ``reshard_files``'s). The minimum-cost flow from the old sizes to equal
    capacities says how many bytes each old shard sends where; rows that leave are rewritten into
    files of their new shard, in the shared folder, and rows that stay are read where they are. New sizes
    differ from the capacity by half a unit for each of the few cuts that touch the shard.

    Equal texts share a shard unless no shard has room for all of them: then ``split`` says so. A null
    text counts as empty. Null ids and repeated rows are placed like any other; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = sized(df, id_col=id_col, text_col=text_col).withColumn("old", F.pmod("text_hash", F.lit(old_shards)).cast("int"))
    placed, _ = _moves(rows, shards, old_shards)
    stay = placed.where(F.col("shard") == F.col("old"))
    path = fresh_path(df.sparkSession, "moved")
    moved = placed.where(F.col("shard") != F.col("old"))
    # files of one shard come from few tasks; a shard's bytes are spread over its blocks
    moved.repartition(*RUN).write.partitionBy("shard").parquet(path)
    return stay.unionByName(df.sparkSession.read.schema(moved.schema).parquet(path).select(*COLUMNS))


def reshard_files(spark: SparkSession, path: str, out: str, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """Reshards the Parquet folder ``path`` (a folder ``shard=K`` for each old shard K from 0, all with
    the same columns) into ``shards`` shards.

    Old sizes are read from the files. Shards that the flow leaves as they are stay where they are, as
    files; of the others the new contents, rows that stay and rows that come, are written to
    ``out/shard=K``. Returns the table read from both, with all columns and shard, and a report: moved
    bytes, the least that can be moved, the shards left alone and those written.
    """
    rows_in = spark.read.parquet(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = {"doc_id": F.col(id_col).cast("long"), "size": (F.octet_length(text) + 8).cast("long"), "text_hash": F.xxhash64(text), "old": F.col("shard").cast("int")}
    rows = rows_in.select(*(column.alias(name) for name, column in keys.items()))
    old_shards = 1 + (rows_in.agg(F.max("shard").cast("int")).first()[0] or 0)
    placement = Placement(rows, shards, old_shards)
    data = [c for c in rows_in.columns if c != "shard"]
    whole = rows_in.select(F.struct(*data).alias("row_data"), *(column.alias(name) for name, column in keys.items()))
    placed = placement._keyed(whole).withColumn("shard", placement.shard()).select("row_data", "old", "block", "part", "turn", "size", "shard")
    flows = placed.groupBy("old", "shard").agg(F.sum("size").alias("bytes")).collect()  # old times new shards at most
    touched = {k for r in flows if r["old"] != r["shard"] for k in (r["old"], r["shard"])}
    alone = sorted({r["old"] for r in flows} - touched)
    written = sorted({r["shard"] for r in flows} & touched)
    changed = placed.where(F.col("shard").isin(*written)) if written else placed.limit(0)
    changed.repartition(*RUN).select("row_data.*", "shard").write.partitionBy("shard").parquet(out)
    report = {"moved": sum(r["bytes"] for r in flows if r["old"] != r["shard"]), "least_moved": placement.least_moved, "left_alone": alone, "written": written}
    left = rows_in.where(F.col("shard").isin(*alone)) if alone else rows_in.limit(0)
    return left.unionByName(spark.read.schema(rows_in.schema).parquet(out)) if written else left, report


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshard(table(spark, sf_dir, "documents")).select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), *RUN, "text_hash", "split")
    rows = saved(rows, "placed")
    counts = rows.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*RUN[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*RUN, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*RUN).orderBy("text_hash", "doc_id")) - 1
    return rows.withColumn("place", place).join(offsets, RUN).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "split"
    )
