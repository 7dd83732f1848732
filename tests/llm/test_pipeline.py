"""Each stage of the pipeline against brute force on its own input."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from countloom.llm import decontaminate, quality
from tests.llm.test_ops import plain_components, plain_copies, plain_fingerprint


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, repeated rows, ties, columns with clashing names, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, sha string, gone_id long, item long, score double"
    rows = [(1, None, None, None, None, None, None, None, None), (None, None, "x", None, 1, "s", 1, 1, 1.0), (None, "some words here to read", None, "y", 2, None, 2, 2, None)]
    rows += [(2, "some words here to read", None, None, 3, "s", None, None, None)] * 2 + [(3, "", "a", "b", 4, "t", 3, 3, 0.0), (4, "long " * 30_000, "a", "b", 5, None, 4, 4, 0.5)]
    docs = spark.createDataFrame(rows, schema)
    for (name, stage), left in zip(corpus_pipeline.STAGES, (None, 3, 3, 7, 7)):
        out, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0
        found = Counter(map(tuple, out.collect()))
        assert name == "bpe" or (out.columns == docs.columns and not found - Counter(rows))
        assert left is None or found.total() == left, name


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, sf_dir)
    assert good.columns == columns
    scored = quality.op2_quality(spark, sf_dir).where("predicted = 1")
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in scored.select("doc_id").collect())

    good = good.toPandas()
    once = steps["exact_dedup"](spark, spark.createDataFrame(good, docs.schema), sf_dir)
    assert once.columns == columns
    best = {}
    for k, text in zip(good["doc_id"], good["text"]):
        best[text.encode().lower()] = max(k, best.get(text.encode().lower(), -1))
    once = once.toPandas()
    assert sorted(once["doc_id"]) == sorted(best.values())

    single = steps["near_dedup"](spark, spark.createDataFrame(once, docs.schema), sf_dir)
    assert single.columns == columns
    groups = plain_components([(int(k), plain_fingerprint(t)) for k, t in zip(once["doc_id"], once["text"])])
    single = single.toPandas()
    assert sorted(single["doc_id"]) == sorted({c for _, _, c in groups})

    clean = steps["decontaminate"](spark, spark.createDataFrame(single, docs.schema), sf_dir)
    assert clean.columns == columns
    clean = clean.toPandas()
    gone = set(single["doc_id"]) - set(clean["doc_id"])
    benchmark = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    items = [(k, t) for k, t in zip(benchmark["item_id"], benchmark["text"])]
    joined = {k: " ".join(decontaminate.words_of(t)) for k, t in zip(single["doc_id"], single["text"])}
    exact = {k for k, t in joined.items() if any(" ".join(decontaminate.words_of(p)) in t for _, p in items)}
    assert exact <= gone
    short = [(k, t) for k, t in zip(single["doc_id"], single["text"]) if len(t) < 600][:8]
    assert {k for k, _ in plain_copies(short, items[:10], decontaminate.LEAST_SCORE)} <= gone

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in steps["bpe"](spark, spark.createDataFrame(clean, docs.schema), sf_dir).collect()}
    assert set(got) == set(clean["doc_id"])
    for k, text in zip(clean["doc_id"], clean["text"]):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(clean["doc_id"])
