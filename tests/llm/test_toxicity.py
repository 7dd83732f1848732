"""Operator 12 against brute force, held-out labels, and its odd cases."""

import zlib
from collections import Counter

import numpy as np
import pytest

from countloom.llm import toxicity

RNG = np.random.default_rng(5)
SCHEMA = "doc_id long, text string, score double, label string, evidence int"


def random_vectors(n, terms, most):
    out = []
    for _ in range(n):
        own = np.sort(RNG.choice(terms, RNG.integers(1, most), replace=False))
        w = RNG.integers(1, 6, len(own)).astype(float)
        out.append((own, w / np.sqrt((w * w).sum())))
    return out


@pytest.mark.parametrize("n, terms, most, k", [(1, 3, 2, 5), (40, 3, 3, 7), (700, 12, 6, 15), (1500, 400, 9, 15)])
def test_nearest_is_that_of_all_examples(n, terms, most, k):
    """Many ties, examples of equal vectors, and blocks whose bound never opens them."""
    vectors, ids, labels = random_vectors(n, terms, most), RNG.permutation(5 * n)[:n], RNG.integers(0, 2, n)
    index = toxicity.build_index(ids, labels, vectors, terms)
    assert sorted(index.ids) == sorted(ids) and len(index.weights) == sum(len(t) for t, _ in vectors)
    queries = random_vectors(40, terms, most)
    for own in (None, np.array([-1, 0] * 20)):
        numbers, similar = toxicity.nearest(index, queries, k, own)
        for row, (terms_, weights) in enumerate(queries):
            dense = np.zeros(terms)
            dense[terms_] = weights
            left_out = int(index.ids[own[row]]) if own is not None and own[row] >= 0 else None
            all_ = [(-round(float(dense[t] @ w), 9), int(i)) for i, (t, w) in zip(ids, vectors) if i != left_out and dense[t] @ w > 0]
            want = sorted(all_)[:k]
            assert [int(index.ids[m]) for m in numbers[row] if m >= 0] == [i for _, i in want]
            assert np.allclose(similar[row, : len(want)], [-s for s, _ in want]) and not similar[row, len(want) :].any()


def test_few_blocks_are_opened():
    """Distant blocks stay closed: their postings are never read."""
    vectors = [(np.array([k // 100, 50]), np.array([0.99, 0.141])) for k in range(4000)]
    index = toxicity.build_index(np.arange(4000), np.zeros(4000, int), vectors, 51)
    opened = []

    class Seen(list):
        def __getitem__(self, at):
            opened.append(at)
            return super().__getitem__(at)

    index.__dict__["blocks"] = Seen(index.blocks)
    numbers, _ = toxicity.nearest(index, [(np.array([7, 50]), np.array([0.99, 0.141]))], 15)
    assert set(index.ids[numbers[0]]) == set(range(700, 715)) and len(opened) <= 3


def test_terms_and_screen():
    """The screened lookup counts what all terms would, in any script."""
    texts = ["Idiot idiots idiotic, IDIOT! x", "", "你好世界 abc世", "naïve Straße a1_b2 achlichkeiten", "é" * 5000, "idio id idiot's"]
    for vocabulary in (["idiot", "idiot*", "id", "世界", "achli*", "achlich*", "x", "世"], ["zzz"], []):
        numbers = {term: k for k, term in enumerate(vocabulary)}
        look = toxicity.Lookup(numbers)
        for text in texts:
            full = toxicity.terms_of(text)
            assert look(text) == {numbers[t]: n for t, n in full.items() if t in numbers}
    assert toxicity.terms_of("Idiotic idiotic") == Counter({"idiotic": 2, "idiot*": 2, "idioti*": 2})


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_labels_and_evidence(fitted):
    docs, labels, model = fitted
    got = toxicity.score(docs, model, evidence=True).toPandas()
    truth = labels.toPandas().set_index("doc_id")["toxic"]
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == got["predicted"]).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"] & got["doc_id"].isin(truth.index)]
    assert (held["predicted"] == truth.loc[held["doc_id"]].to_numpy()).mean() > 0.92
    learned = {int(i) for i in truth.index if zlib.crc32(str(i).encode()) % 5}
    used = 0
    for evidence in got["evidence"]:
        assert len(evidence) <= toxicity.NEAREST
        for e in evidence:
            assert e["doc_id"] in learned and e["label"] == truth[e["doc_id"]] and 0 < e["similarity"] < 1 + 1e-9
            used += 1
    assert used


def test_held_out_rows_change_nothing_but_counts(spark, fitted):
    docs, labels, model = fitted
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.fit(docs, flipped)
    assert again.vocabulary == model.vocabulary and (again.index.weights == model.index.weights).all() and again.slope == model.slope


def test_odd_rows(spark, fitted):
    model = fitted[2]
    rows = [(1, None, 0.1, "a", 1), (2, "", None, None, None), (3, "you idiot, you trash " * 5, 0.2, "b", 2), (3, "you idiot, you trash " * 5, 0.2, "b", 2), (None, "kind words", 0.3, "c", 3), (4, "plain " * 300_000 + "idiot trash moron scum", None, "d", 4), (5, "\n\t ", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score(df, model).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 1, 1, 0] and got[0].doc_id is None and got[0].held_out is False
    assert got[1].score == got[2].score == got[6].score == got[0].score and got[3] == got[4]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_little_or_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0, "x", 1), (2, None, None, None, None), (2, "c", None, None, None)], SCHEMA)
    for labels in ([], [(1, 0, 0), (None, 1, 1), (2, 1, None), (3, 0, 7)], [(2, 0, 1), (2, 0, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert len(scores) == 3 and all(0 < s < 1 for s in scores)
    model = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score == pytest.approx(0.25)
