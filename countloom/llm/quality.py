"""Operator 2: document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, table, texts_of

#: Labelled rows that the fit may read at most, and preference pairs made of them.
SAMPLE_ROWS, PAIRS = 20_000, 200_000
#: Characters whose share is a feature of its own.
MARKS = "!*#$%&|<>{}=_/@\"'()[]?:;-,.\n\t"
NAMES = (
    "log_bytes", "upper", "lower", "digit", "blank", "wide", *(f"mark_{ord(c):02x}" for c in MARKS), "log_words", "word_bytes", "distinct_words",
    "top_word", "repeats_next", "marked_words", "shouted_words", "distinct_lines", "top_line", "log_line_bytes", "sentence_words",
)
_PLAIN = bytes(b for b in range(256) if b < 128 and not chr(b).isalnum() and not chr(b).isspace() and chr(b) not in ".,;:'\"?-()")


def features_of(text: str) -> np.ndarray:
    """Shares and lengths of the whole text; an empty text has zeros only."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    own = [np.log1p(len(raw)), counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[32], counts[128:].sum(), *counts[[ord(c) for c in MARKS]]]
    if words:
        times, n = Counter(words), len(words)
        distinct = b"\n".join(times)
        marked = sum(k for w, k in times.items() if w[-1] in _PLAIN)
        shouted = sum(k for w, k in times.items() if len(w) > 1 and w.isupper())
        own += [np.log1p(n), min(len(distinct) / len(times), 50), len(times) / n, max(times.values()) / n]
        own += [sum(map(bytes.__eq__, words, words[1:])) / n, marked / n, shouted / n]
        rows = Counter(lines)
        own += [len(rows) / len(lines), max(rows.values()) / len(lines), np.log1p(len(raw) / len(lines)), min(n / (1 + raw.count(b". ") + raw.count(b".\n")), 100)]
    out[: len(own)] = own
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, and the score that parts the classes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_ranking(x: np.ndarray, label: np.ndarray, *, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 30, seed: int = 7) -> Ranking:
    """Bradley-Terry: a document of label 1 is preferred to one of label 0 with
    probability sigmoid(score difference); Newton steps on the logistic loss of the
    pairs' feature differences. The threshold is the quantile of the sample's scores
    at the share of label 0. With one class only, all weights are zero and every
    document gets that class.
    """
    if not len(x):
        return Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(poor):
        return Ranking(mean, scale, weights, -1.0 if len(good) else 1.0)
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        slope = difference.T @ miss / pairs - ridge * weights
        curve = (difference * (miss * (1 - miss))[:, None]).T @ difference / pairs + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    own = np.sort(z @ weights)
    below = int(np.clip(len(poor), 1, len(own) - 1))
    return Ranking(mean, scale, weights, float((own[below - 1] + own[below]) / 2))


def held_out(column):
    """Rows that no fit sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(column.cast("string").cast("binary")) % 3 == 1


def _with_features(df: DataFrame, weigh, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.stack([features_of(text or "") for text in texts]) if texts else np.zeros((0, len(NAMES)))
            yield weigh(batch, x)

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """Fits on at most ``sample_rows`` labelled documents, chosen by a hash of the id,
    never on held-out ones. Only their features (some forty numbers a row) reach the driver.
    Labels other than 0 and 1, and null ids, are left out; of several labels of one
    id the smaller counts, of several texts the one with the smallest hash, so that the same tables give
    the same fit. Nulls count as empty texts. Without labels every document counts as good."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = texts_of(docs, id_col, text_col).join(F.broadcast(own), "doc_id")  # sample_rows rows at most

    def weigh(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "text_hash", "x"])

    chosen = chosen.select("doc_id", "text", "quality", F.xxhash64("text").alias("text_hash"))
    rows = _with_features(chosen, weigh, "doc_id long, quality int, text_hash long, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("x", "text_hash").alias("x")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit_ranking(np.stack(rows["x"]) if len(rows) else np.zeros((0, len(NAMES))), rows["quality"].to_numpy())


def score(df: DataFrame, ranking: Ranking, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    The score is the sigmoid of the ranking score's distance from the threshold, so
    0.5 is the quantile that parts the classes. Null and empty texts have features
    of zero and a score like any other. A null id stays null and isn't held out;
    repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """

    def weigh(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        scores = ranking.scores(x)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = texts_of(df, id_col, text_col).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return _with_features(own, weigh, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, ranking: Ranking, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whatever their names, whose score is 0.5 or more.
    Null texts count as empty and are scored like any other; repeated rows and rows without an id are each
    judged by their text; an empty table gives an empty result."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features_of(text or "") for text in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(ranking.scores(x) >= 0.5))

    return df.mapInArrow(run, df.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
