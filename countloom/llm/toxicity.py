"""Operator 12: toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, map_batches, saved, table, texts_of

#: Labelled rows that the fit may read at most, and terms that it may keep.
SAMPLE_ROWS, VOCABULARY = 10_000, 2048
#: A term is kept if it stands in this many toxic examples, in a larger share of them than of the
#: clean ones, and the likelihood ratio G says that this is no chance (15: one term in ten thousand).
LEAST_EXAMPLES, LEAST_G = 3, 15.0
#: Neighbours that vote, examples of a block, and what is added to a neighbour's distance.
NEAREST, BLOCK, SOFT = 15, 64, 0.05
#: Texts that are searched for at once.
QUERIES = 1024
#: Word starts of these lengths are terms of their own, so that inflected and compound forms meet.
STARTS = (5, 6, 7, 8)
#: Words that begin or end with a character from here on are of scripts without blanks.
WIDE = "⺀"
_WORD = re.compile(r"\w+")


def terms_of_word(word: str) -> list[str]:
    """The word, its starts, and, in scripts without blanks, its pairs of characters."""
    if word[0] >= WIDE or word[-1] >= WIDE:
        return [word[k : k + 2] for k in range(max(len(word) - 1, 1))]
    return [word, *(f"{word[:k]}*" for k in STARTS if len(word) > k)]


def terms_of(text: str) -> Counter:
    """Counts of the terms of a whole text, in small letters."""
    out: Counter = Counter()
    for word, times in Counter(_WORD.findall(text.lower())).items():
        for term in terms_of_word(word):
            out[term] += times
    return out


class Lookup:
    """Counts of the vocabulary's terms in texts. Only words that begin like a term, or may be cut into pairs, are
    looked at more closely."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.heads = vocabulary, {term.rstrip("*")[: STARTS[0]] for term in vocabulary}

    def __call__(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        if not self.vocabulary:
            return out
        heads, first = self.heads, STARTS[0]
        words = [word for word in _WORD.findall(text.lower()) if word[:first] in heads or word[0] >= WIDE or word[-1] >= WIDE]
        for word, times in Counter(words).items():
            for term in terms_of_word(word):
                number = self.vocabulary.get(term)
                if number is not None:
                    out[number] = out.get(number, 0) + times
        return out


@dataclass(frozen=True)
class Index:
    """Postings of the examples that have terms, in blocks of ``BLOCK`` examples: for each block its terms, each with
    the weights of the block's examples, and each term's largest weight in each block."""

    ids: np.ndarray  # of the examples, by number
    labels: np.ndarray
    order: np.ndarray  # place of each example in the order of the ids
    highest: np.ndarray  # term, block
    cells: np.ndarray  # where a block's postings begin
    terms: np.ndarray  # term, example and weight of each posting, block by block
    numbers: np.ndarray
    weights: np.ndarray

    @cached_property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block the row of each term, and the rows: its weights by example; the last row is zero, for
        terms that the block doesn't have."""
        out = []
        for block in range(self.highest.shape[1]):
            at = slice(self.cells[block], self.cells[block + 1])
            terms, place = np.unique(self.terms[at], return_inverse=True)
            weights = np.zeros((len(terms) + 1, BLOCK))
            weights[place, self.numbers[at] % BLOCK] = self.weights[at]
            rows = np.full(len(self.highest), len(terms), np.int32)
            rows[terms] = np.arange(len(terms))
            out.append((rows, weights))
        return out


def build_index(ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
    """Examples with the same label and the same heaviest term stand together, which keeps the
    largest weights of most blocks small for most terms."""
    heaviest = np.array([terms[np.argmax(w)] for terms, w in vectors], np.int64).reshape(len(vectors))
    order = np.lexsort((ids, heaviest, labels))
    ids, labels, vectors = ids[order], labels[order], [vectors[k] for k in order]
    number = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]).astype(np.int64)
    term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
    weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
    n_blocks = -(-len(ids) // BLOCK)
    highest = np.zeros((n_terms, n_blocks))
    np.maximum.at(highest, (term, number // BLOCK), weight)
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return Index(ids, labels, place, highest, np.searchsorted(number // BLOCK, np.arange(n_blocks + 1)), term, number, weight)


def nearest(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (-1: none) and similarities of the ``k`` examples nearest to each query, nearest first, the smaller id first
    where they tie; only those that share a term. ``without`` leaves an example's number out of each query (-1: none).

    A block can't reach more than the query's weights times its largest ones. Each query opens the two blocks with the highest
    such bounds; then, block by block, those queries open it whose k-th best its bound may reach, so the result is
    that of all examples. Queries that open the same block are multiplied with it at once, by their own few terms.
    """
    n, size = len(queries), max(len(index.ids), 1)
    lengths = np.array([len(terms) for terms, _ in queries], np.int64)
    starts = np.cumsum(lengths) - lengths
    terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
    n_blocks = index.highest.shape[1]
    best = np.full((n, k), -1, np.int64)  # similarity in billionths, then the id's place from behind: larger is nearer
    if n_blocks:
        bound = np.add.reduceat(index.highest[terms] * weights[:, None], starts, axis=0)
        opened = np.zeros((n, n_blocks), bool)

    def open_block(block: int, rows: np.ndarray) -> None:
        opened[rows, block] = True
        own = lengths[rows]
        first = np.cumsum(own) - own
        at = np.repeat(starts[rows] - first, own) + np.arange(own.sum())
        line, cells = index.blocks[block]
        low = block * BLOCK
        count = min(BLOCK, len(index.ids) - low)
        similar = np.add.reduceat(cells[line[terms[at]], :count] * weights[at, None], first, axis=0)
        similar = np.rint(similar * 1e9).astype(np.int64)
        keys = np.where(similar > 0, similar * size + (size - 1 - index.order[low : low + count]), -1)
        if without is not None:
            keys[without[rows][:, None] == np.arange(low, low + count)] = -1
        best[rows] = np.partition(np.concatenate([best[rows], keys], 1), count, axis=1)[:, count:]

    for turn in range(min(2, n_blocks)):
        block = np.argmax(np.where(opened, -1.0, bound), axis=1)
        by = np.argsort(block, kind="stable")
        ends = np.flatnonzero(np.r_[True, np.diff(block[by]) != 0, True])
        for low, high in zip(ends[:-1], ends[1:]):
            rows = by[low:high]
            rows = rows[bound[rows, block[rows[0]]] > 0]
            if len(rows):
                open_block(int(block[rows[0]]), rows)
    for block in range(n_blocks):
        least = best.min(1)
        reach = np.where(least < 0, 0.0, least // size / 1e9 - 2e-9)
        rows = np.flatnonzero(~opened[:, block] & (bound[:, block] > 0) & (bound[:, block] >= reach))
        if len(rows):
            open_block(block, rows)
    best = -np.sort(-best, axis=1)
    found = best >= 0
    at_place = np.argsort(index.order, kind="stable")
    return np.where(found, at_place[np.where(found, size - 1 - best % size, 0)] if len(index.ids) else -1, -1), np.where(found, best // size / 1e9, 0.0)


@dataclass(frozen=True)
class Model:
    """Vocabulary, idf, index, share of toxic examples among those without a term and among all, and
    the line that turns a vote's log odds into a score's."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    index: Index
    without_terms: float
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weights = (1 + np.log(np.array([counts[t] for t in terms.tolist()], float))) * self.idf[terms]
        return terms, weights / np.sqrt((weights * weights).sum())

    def votes(self, counts: list[dict[int, int]], without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the share of toxic ones among the nearest examples, each weighted by the inverse of its distance, one
        weight going to the share among all; and these examples' numbers and similarities."""
        out = np.full(len(counts), self.without_terms)
        numbers, similar = np.full((len(counts), NEAREST), -1), np.zeros((len(counts), NEAREST))
        rows = np.array([row for row, own in enumerate(counts) if own], np.int64)
        for at in range(0, len(rows), QUERIES):
            own = rows[at : at + QUERIES]
            found, near = nearest(self.index, [self.vector(counts[row]) for row in own], NEAREST, None if without is None else without[own])
            pull = np.where(found >= 0, 1 / (np.clip(1 - near, 0, 1) + SOFT), 0.0)
            toxic = self.index.labels[found] if len(self.index.ids) else np.zeros(found.shape)
            out[own] = ((pull * toxic).sum(1) + self.prior) / (pull.sum(1) + 1)
            numbers[own], similar[own] = found, near
        return out, numbers, similar

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.shift + self.slope * _log_odds(votes))))


def _log_odds(votes: np.ndarray) -> np.ndarray:
    votes = np.clip(votes, 1e-4, 1 - 1e-4)
    return np.log(votes / (1 - votes))


def calibrated(votes: np.ndarray, labels: np.ndarray, *, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic line from votes' log odds to labels, by Newton steps; a slope
    below a tenth, or labels of one class, leave the votes as they are."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x = np.stack([_log_odds(votes), np.ones(len(votes))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - ridge * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), slope)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0.1 else (1.0, 0.0)


def held_out(column):
    """Rows that no fit sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def _counted(df: DataFrame, count, names: tuple[str, ...]) -> DataFrame:
    """Sums by term of what ``count(batch, Counters)`` adds up within a task."""
    bounded_batches(df.sparkSession)
    schema = ", ".join(["term string", *(f"{name} long" for name in names)])

    def run(batches):
        sums = [Counter() for _ in names]
        for batch in batches:
            count(batch, sums)
        for terms in [sorted(set().union(*sums))]:
            for at in range(0, len(terms), 10_000):
                part = terms[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[t] for t in part], pa.int64()) for s in sums)], ["term", *names])

    return df.mapInArrow(run, schema).groupBy("term").agg(*(F.sum(name).alias(name) for name in names))


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = texts_of(docs, id_col, text_col).join(F.broadcast(own), "doc_id")  # sample_rows rows at most
    return chosen.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """The index of at most ``sample_rows`` labelled documents, chosen by a hash of the id, never held-out ones.

    The ``vocabulary`` terms that speak most for toxic examples are kept; their document frequencies are counted over all
    of ``docs``. Labels other than 0 and 1, and null ids, are left out; of several labels of an id the
    larger counts, of several texts the one with the smallest hash. Nulls count as empty texts.
    Votes of the examples, each without itself, give the calibration. Without labels every document scores 1 / 4.
    """
    chosen = saved(_examples(docs, labels, id_col, text_col, label_col, sample_rows), "examples")

    def by_label(batch: pa.RecordBatch, sums: list[Counter]) -> None:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[label].update(set(terms_of(text)))
            sums[label][""] += 1

    terms = saved(_counted(chosen.select("label", "text"), by_label, ("b", "a")), "terms")
    sizes = terms.where("term = ''").select("a", "b").first()
    n1, n0 = (sizes["a"], sizes["b"]) if sizes else (0, 0)
    n = n1 + n0

    def part(seen, whole: int):  # of G: what is seen against what is expected
        own, all_ = F.col(seen), F.col("a") + F.col("b")
        has = F.when(own > 0, own * F.log(own * n / (all_ * whole))).otherwise(0.0)
        lacks = F.when(own < whole, (whole - own) * F.log((whole - own) * n / ((n - all_) * whole))).otherwise(0.0)
        return has + lacks

    kept = []
    if n1 and n0:
        good = terms.where((F.col("term") != "") & (F.col("a") >= LEAST_EXAMPLES) & (F.col("a") * n0 > F.col("b") * n1))
        good = good.withColumn("g", 2 * (part("a", n1) + part("b", n0))).where(F.col("g") >= LEAST_G)
        kept = [row["term"] for row in good.orderBy(F.desc("g"), "term").limit(vocabulary).collect()]
    numbers = {term: k for k, term in enumerate(kept)}

    def in_all(batch: pa.RecordBatch, sums: list[Counter]) -> None:
        look = Lookup(numbers)
        for text in batch.column(0).to_pylist():
            sums[0].update(kept[t] for t in look(text))
        sums[0][""] += batch.num_rows

    counts = {row["term"]: row["df"] for row in _counted(texts_of(docs, id_col, text_col).select("text"), in_all, ("df",)).collect()} if kept else {}
    idf = np.array([np.log((1 + counts.get("", 0)) / (1 + counts.get(term, 0))) + 1 for term in kept])

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        look = Lookup(numbers)
        found = [look(text) for text in batch.column(2).to_pylist()]
        arrays = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "label", "terms", "times"])

    picked = saved(map_batches(chosen.select("doc_id", "label", "text"), pick, "doc_id long, label int, terms array<int>, times array<long>"), "picked")
    rows = picked.orderBy("doc_id").collect()  # sample_rows rows at most
    bare = [row["label"] for row in rows if not row["terms"]]
    rows = [row for row in rows if row["terms"]]
    prior = (n1 + 0.5) / (n + 2)
    empty = build_index(np.zeros(0, np.int64), np.zeros(0, np.int64), [], len(kept))
    model = Model(numbers, idf, empty, (sum(bare) + prior) / (len(bare) + 1), prior)
    vectors = [model.vector(dict(zip(row["terms"], row["times"]))) for row in rows]
    model = replace(model, index=build_index(np.array([r["doc_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), vectors, len(kept)))

    number_of = {int(doc_id): k for k, doc_id in enumerate(model.index.ids)}

    def without_itself(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, terms, times = (batch.column(c).to_pylist() for c in (0, 2, 3))
        votes = model.votes([dict(zip(t, k)) for t, k in zip(terms, times)], np.array([number_of.get(i, -1) for i in ids], np.int64))[0]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.float64())], ["doc_id", "label", "vote"])

    votes = map_batches(picked, without_itself, "doc_id long, label int, vote double").orderBy("doc_id").collect()
    slope, shift = calibrated(np.array([r["vote"] for r in votes]), np.array([r["label"] for r in votes], float))
    return replace(model, slope=slope, shift=shift)


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", evidence: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score (0 to 1), predicted (0 or 1), and with ``evidence``
    the examples that voted: an array of (doc_id, similarity, label), nearest first.

    Null and empty texts, and others without a term, get the share of toxic ones among examples without a
    term. A null id stays null and isn't held out; repeated rows give repeated results; very long
    texts count whole; other columns are ignored; an empty table gives an empty result.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_ROWS and VOCABULARY
    schema = "doc_id long, held_out boolean, score double, predicted int"
    bounded_batches(df.sparkSession)

    def run(batches):
        model = sent.value
        look = Lookup(model.vocabulary)
        for batch in batches:
            votes, numbers, similar = model.votes([look(text) for text in batch.column(2).to_pylist()])
            scores = model.score(votes)
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
            names = ["doc_id", "held_out", "score", "predicted"]
            if evidence:
                own = model.index
                lists = [[{"doc_id": int(own.ids[k]), "similarity": float(s), "label": int(own.labels[k])} for k, s in zip(*row) if k >= 0] for row in zip(numbers, similar)]
                arrays.append(pa.array(lists, pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))))
                names.append("evidence")
            yield pa.RecordBatch.from_arrays(arrays, names)

    own = texts_of(df, id_col, text_col).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    more = ", evidence array<struct<doc_id long, similarity double, label int>>" if evidence else ""
    return own.mapInArrow(run, schema + more)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
