"""Operator 1: token counts of whole texts."""

from __future__ import annotations

import json
import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from countloom.llm.common import map_batches, table, texts_of
from countloom.llm.pieces import cut, cuttable, in_groups, packed

#: Bytes of text handed to the library in one call.
CALL_BYTES = 256 << 10
#: Parts whose lengths a worker remembers, and the longest part that it remembers.
MEMO_PARTS, MEMO_CHARS = 300_000, 48


def _cuttable(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        return cuttable(json.load(file))


@lru_cache(maxsize=2)
def _library(path: str):
    """The library's tokenizer, lengths of parts that it remembers, and whether texts may be cut."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, {}, _cuttable(path)


@lru_cache(maxsize=2)
def _pieces_library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _lengths(tokenizer, parts: list[str]) -> dict[str, int]:
    """Token counts of distinct parts, encoded in calls of about as many bytes."""
    found: dict[str, int] = {}
    for group in packed(parts, CALL_BYTES):
        encoded = tokenizer.encode_batch_fast(group, add_special_tokens=False)
        found.update(zip(group, map(len, encoded)))
    return found


def _count_batch(texts: list[str], path: str) -> list[int]:
    """Parts that repeat within the batch are encoded once and remembered; the rest
    of a text is joined again, which adds no other cut than safe ones, and encoded
    in blocks of at most ``CALL_BYTES`` unless one part is longer."""
    tokenizer, memo, _ = _library(path)
    rows = [cut(text) for text in texts]
    seen = Counter(part for row in rows for part in row if part not in memo)
    again = [part for part, n in seen.items() if n > 1 and len(part) <= MEMO_CHARS]
    memo.update(_lengths(tokenizer, again[: max(0, MEMO_PARTS - len(memo))]))
    blocks: list[str] = []
    owners: list[int] = []
    counts = [0] * len(rows)
    for k, row in enumerate(rows):
        known = [memo.get(part) for part in row]
        rest = [part for part, n in zip(row, known) if n is None]
        counts[k] = sum(n for n in known if n is not None)
        block: list[str] = []
        size = 0
        for part in rest:
            if block and size + len(part) > CALL_BYTES:
                blocks.append("".join(block))
                owners.append(k)
                block, size = [], 0
            block.append(part)
            size += len(part)
        if block:
            blocks.append("".join(block))
            owners.append(k)
    lengths = _lengths(tokenizer, list(set(blocks)))
    for k, block in zip(owners, blocks):
        counts[k] += lengths[block]
    return counts


def token_counts_of(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the file's library counts them."""
    if path.endswith(".model"):
        return [len(ids) for ids in _pieces_library(path).encode(texts, num_threads=1)]
    if not _library(path)[2]:
        lengths = _lengths(_library(path)[0], list(set(texts)))
        return [lengths[text] for text in texts]
    return [sum(own) for own in in_groups(texts, lambda group: _count_batch(group, path))]


def count_tokens(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_tokens, over_limit.

    Texts are cut at safe places (see ``pieces.py``); parts that repeat are encoded once, all
    others in blocks, in calls balanced by bytes, and only lengths leave the worker. A file
    with another split pattern, a normalizer or further added tokens, and a
    sentencepiece model, have no places known to be safe: then whole texts are encoded.
    Nothing is truncated, padded or added; strings of special tokens inside a text are
    treated as the library does by default. One narrow stage, no shuffle.

    Nulls and empty texts: 0 bytes, 0 tokens. A text without safe places is one part.
    A null id stays null; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        counts = np.array(token_counts_of(texts, tokenizer_path), np.int64)
        sizes = [len(text.encode("utf-8", "surrogatepass")) for text in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(texts_of(df, id_col, text_col), step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
