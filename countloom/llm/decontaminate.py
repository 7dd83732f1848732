"""Operator 6: benchmark passages in training documents, by rare seeds and
Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, map_batches, table, texts_of

#: Points that an alignment needs at least (a shorter item has to be there word by word), and the
#: score (share of a perfect alignment) that convicts.
LEAST_WORDS, LEAST_SCORE = 3, 0.5
#: Costs of the alignment: a match gains 1.
MISMATCH, GAP = 0.5, 0.5
#: Share of an item's words, the rarest in the corpus, that are its seeds.
RARE_SHARE = 0.75
#: Items times words of a text that are bounded at once.
BLOCK_CELLS = 500_000
#: Words of benchmark text that one pass over the documents looks for: some 50 MB a worker.
BLOCK_WORDS = 2_000_000
_PLAIN = {k: chr(k).lower() if chr(k).isalnum() else " " for k in range(128)}
#: Characters of scripts that are written without blanks (Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese).
_BLANKLESS = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased: case and marks don't hide a copy. In scripts without
    blanks each character is a word, so that a copy within a longer text, or with marks put in, is found there too."""
    text = text or ""
    if text.isascii():
        return text.translate(_PLAIN).split()
    text = text.lower()
    kinds = set(text)
    if max(kinds) >= "\u0e00":
        text = _BLANKLESS.sub(r" \g<0> ", text)
    for c in kinds:
        if not c.isalnum():
            text = text.replace(c, " ")
    return text.split()


@dataclass
class Items:
    """A block of benchmark items as word numbers (from 1; 0 is any other word)."""

    ids: list[int | None]
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    points: np.ndarray  # that an alignment with the item must reach
    first: np.ndarray  # of each word's postings
    owner: np.ndarray  # item of each posting
    times: np.ndarray  # how often the word is among the item's rare seeds
    least_hits: np.ndarray  # rare seeds of the item that any such alignment holds

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]]) -> Items:
        vocabulary: dict[str, int] = {}
        for _, words in rows:
            for word in words:
                vocabulary.setdefault(word, len(vocabulary) + 1)
        none = np.zeros(0, np.int64)
        return cls([k for k, _ in rows], vocabulary, [np.array([vocabulary[w] for w in words], np.int64) for _, words in rows], none, none, none, none, none)

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def seed(self, document_counts: np.ndarray, share: float, least: float) -> None:
        """Makes each item's rarest words, ``share`` of them, its seeds.

        An alignment that reaches the score leaves at most (length - points) of the
        item's words unmatched, so it holds all seeds but so many; there are always
        enough seeds for one to be left, however frequent they are."""
        sizes = np.array([len(x) for x in self.words], np.int64)
        self.points = np.maximum(least * sizes, np.minimum(LEAST_WORDS, sizes))
        spare = sizes - np.ceil(self.points).astype(np.int64)
        n_seeds = np.minimum(np.maximum(np.ceil(share * sizes).astype(np.int64), spare + 1), sizes)
        self.least_hits = n_seeds - spare
        seeds = [np.unique(x[np.argsort(document_counts[x], kind="stable")[:n]], return_counts=True) for x, n in zip(self.words, n_seeds)]
        word, self.times = np.concatenate([x for x, _ in seeds]), np.concatenate([n for _, n in seeds])
        self.owner = np.repeat(np.arange(len(seeds)), [len(x) for x, _ in seeds])
        order = np.argsort(word, kind="stable")
        self.owner, self.times = self.owner[order], self.times[order]
        self.first = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 2))

    def regions_in(self, numbers: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(item, stretches of the text) that no bound excludes; every alignment that
        reaches the item's points lies within one of them.

        The first bound is the number of seeds in the text. The second is the best sum
        over a stretch, where a word of the item counts 1 and any other word costs at
        least what a mismatch or a gap does."""
        words, place, times = np.unique(numbers, return_inverse=True, return_counts=True)
        sizes = self.first[words + 1] - self.first[words]
        if not sizes.any():
            return
        posting = np.repeat(self.first[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        hits = np.bincount(self.owner[posting], np.minimum(self.times[posting], np.repeat(times, sizes)), len(self.ids))
        near = np.flatnonzero(hits >= self.least_hits)
        step = max(1, BLOCK_CELLS // len(numbers))
        kind = np.float32 if len(numbers) < 1 << 20 else np.float64  # sums stay exact
        for some in (near[k : k + step] for k in range(0, len(near), step)):
            own = np.concatenate([self.words[k] for k in some])
            row = np.repeat(np.arange(len(some)), [len(self.words[k]) for k in some])
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            hit = words[at] == own
            gain = np.full((len(some), len(words)), -min(MISMATCH, GAP), kind)
            gain[row[hit], at[hit]] = 1.0
            sums = np.zeros((len(some), len(numbers) + 1), kind)
            np.cumsum(np.take(gain, place, axis=1), axis=1, out=sums[:, 1:])
            before = sums - np.minimum.accumulate(sums, axis=1)  # best sum that ends here
            for k in np.flatnonzero(before.max(axis=1) >= self.points[some]):
                after = np.maximum.accumulate(sums[k, ::-1])[::-1]
                through = after[1:] - sums[k, :-1] + before[k, :-1] >= self.points[some[k]]
                edges = np.flatnonzero(np.diff(through, prepend=False, append=False))
                yield int(some[k]), list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment: its score, and the end (exclusive) in ``text``."""
    steps = GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.zeros(len(text) + 1)
        row[1:] = np.maximum(above[:-1] + np.where(text == word, 1.0, -MISMATCH), above[1:] - GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + steps) - steps, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
        above = row
    return best, end


def best_match(words: np.ndarray, passages: list[tuple[int, np.ndarray]]) -> tuple[float, int, int]:
    """Score, first word and last word + 1 (in the text) of the item's best alignment with one
    of the passages (first word, word numbers); of equal scores the first."""
    best = (0.0, 0, 0)
    for first, passage in passages:
        score, end = align(words, passage)
        if score > best[0]:
            back = align(words[::-1], passage[:end][::-1])[1]
            best = (score, first + end - back, first + end)
    return best


def matches_in(items: Items, numbers: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word + 1) of each item found in the text."""
    for item, regions in items.regions_in(numbers) if len(numbers) else ():
        best = best_match(items.words[item], [(a, numbers[a:b]) for a, b in regions])
        if best[0] >= items.points[item]:
            yield item, best[0] / len(items.words[item]), *best[1:]


def benchmark_blocks(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark, the stated query set, in blocks of bounded size. Items without words are left out; those
    without an id are searched for like any other."""
    rows: list[tuple[int, list[str]]] = []
    held = 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).orderBy(item_col).toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if rows and held + len(words) > block_words:
            yield Items.of(rows)
            rows, held = [], 0
        rows.append((row[0], words))
        held += len(words)
    if rows:
        yield Items.of(rows)


def word_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each word of the block, counted over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(len(sent.value.vocabulary) + 1, np.int64)
        for text in batch.column(1).to_pylist():
            total[np.unique(sent.value.numbers(text))] += 1
        found = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["word", "n"])

    counts = np.zeros(len(items.vocabulary) + 1, np.int64)
    for word, n in map_batches(docs, step, "word long, n long").groupBy("word").agg(F.sum("n")).collect():  # a row a word of the block
        counts[word] = n
    return counts


def prepared(docs: DataFrame, benchmark: DataFrame, *, least_score: float = LEAST_SCORE, rare_share: float = RARE_SHARE) -> Iterator[Items]:
    for items in benchmark_blocks(benchmark):
        items.seed(word_counts(docs, items), rare_share, least_score)
        yield items


_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.binary())]))


def seeded(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, item (its number in the block), passages (first word and word numbers): where a
    text holds so many of an item's rare seeds, and so densely, that the score is within reach."""
    sent = docs.sparkSession.sparkContext.broadcast(items)  # a block, of BLOCK_WORDS at most

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, own, passages = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            numbers = sent.value.numbers(text)
            for item, regions in sent.value.regions_in(numbers) if len(numbers) else ():
                ids.append(doc_id)
                own.append(item)
                passages.append([{"first": a, "words": numbers[a:b].astype("<i4").tobytes()} for a, b in regions])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(passages, _PASSAGES)], ["doc_id", "item", "passages"])

    return map_batches(docs, step, "doc_id long, item long, passages array<struct<first: long, words: binary>>")


def aligned(candidates: DataFrame) -> DataFrame:
    """Smith-Waterman of joined candidates (doc_id, item_id, points, item_words, passages)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, item_id, points, words, passages in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(words, "<i4")
            score, first, end = best_match(own, [(p["first"], np.frombuffer(p["words"], "<i4")) for p in passages])
            if score >= points:
                rows.append((doc_id, item_id, score / len(own), first, end))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return map_batches(candidates.select("doc_id", "item_id", "points", "item_words", "passages"), step, SCHEMA)


SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"


def find_copies(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document row and benchmark item that it copies: doc_id, item_id,
    score (alignment score over the item's length), first_word, end_word.

    A pass over all documents counts how many hold each word of the benchmark; the
    rarest three quarters of each item's words are its seeds. In a second pass the seeds find passages
    with enough of them for the score, and dense enough in the item's words; these passages
    join the items, and what joins is aligned (Smith-Waterman). Both bounds lose no alignment,
    whatever the counts are, so the result is that of aligning every item with every text. An
    alignment counts if it also reaches ``LEAST_WORDS`` points, which bears on items of under
    six words; items of one or two words have to be there word by word. Only passages are
    joined; texts aren't shuffled.

    Null and empty texts match nothing; equal items are all reported; repeated rows
    give repeated results; null ids of documents and of items stay null; other columns are ignored; an empty
    table on either side gives an empty result.
    """
    docs = texts_of(df, id_col, text_col)
    spark, out = docs.sparkSession, None
    for items in prepared(docs, benchmark, least_score=least_score):
        rows = [(k, item_id, float(points), words.astype("<i4").tobytes()) for k, (item_id, points, words) in enumerate(zip(items.ids, items.points, items.words))]
        block = spark.createDataFrame(rows, "item long, item_id long, points double, item_words binary")
        found = aligned(seeded(docs, items).join(F.broadcast(block), "item"))  # a block, of BLOCK_WORDS at most
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_copies(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df``, with all their columns, whatever their names, that copy no
    benchmark item. An item of under ``LEAST_WORDS`` words, which may stand in any text by chance,
    convicts a text that has no other words. Rows with null and empty texts stay, as do
    repeated rows and null ids; an empty benchmark drops nothing. The rows pass through in one
    narrow stage for each block of the benchmark."""
    bounded_batches(df.sparkSession)
    at, out = df.columns.index(text_col), df
    for items in prepared(texts_of(df, id_col, text_col), benchmark, least_score=least_score):
        sent = df.sparkSession.sparkContext.broadcast(items)

        def clean(text: str | None, items: Items) -> bool:
            numbers = items.numbers(text)
            return not any(len(items.words[k]) >= LEAST_WORDS or len(items.words[k]) == len(numbers) for k, *_ in matches_in(items, numbers))

        def run(batches, sent=sent):
            for batch in batches:
                yield batch.filter(pa.array([clean(t, sent.value) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, df.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
