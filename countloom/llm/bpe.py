"""Operator 8: byte-level BPE encoding by speculation and verification, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from countloom.llm.common import map_batches, table, texts_of
from countloom.llm.pieces import cut, cuttable, in_groups

#: Parts whose ids a worker remembers, and the longest part that it remembers.
MEMO_PARTS, MEMO_CHARS = 200_000, 48
#: Pairs whose test a worker remembers; longest word that is merged in lockstep.
KNOWN_PAIRS, LOCKSTEP_BYTES = 2_000_000, 40
NO_RANK = 1 << 40
#: Stands between words in the automaton's input: in no token, as tokens are bytes.
GAP = "\u0100"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


def _unsupported(spec: dict) -> str | None:
    """What keeps this encoder from giving the ids that the file's library gives."""
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers") or [split]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
        return "only plain byte-level BPE models are"
    if spec.get("normalizer"):
        return "normalizers aren't"
    if steps[-1].get("type") != "ByteLevel" or any(s.get("add_prefix_space") for s in steps) or any(s.get("type") not in ("ByteLevel", "Split") for s in steps):
        return "other pre-tokenizers than ByteLevel, behind one split by a pattern or alone, aren't"
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens") or []):
        return "added tokens that take in their surroundings aren't"
    return None


class Vocabulary:
    """Tokens, merges and special strings of a vocabulary file, with the encoder. ``pattern`` is the file's split pattern. Files
    whose ids it couldn't give exactly are an error; texts are cut only where the file's pattern is the one whose safe
    places are known, others are encoded whole."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if (wrong := _unsupported(spec)) is not None:
            raise ValueError(f"{path}: {wrong} supported")
        self.cuts = cuttable(spec)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(token): k for token, k in vocab.items() if token not in special}
        self.bytes_of = {k: token for token, k in self.ids.items()} | {k: s.encode() for s, k in special.items()}
        self.base = max(self.bytes_of) + 1
        self.token_size = np.zeros(self.base, np.int64)
        self.token_size[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        ranked = sorted((left * self.base + right, *found) for (left, right), found in self.merges.items())
        self.merge_codes = np.array([x[0] for x in ranked], np.int64)
        self.merge_ranks = np.array([x[1] for x in ranked], np.int64)
        self.merge_result = np.zeros(len(ranked), np.int64)
        self.merge_result[self.merge_ranks] = [x[2] for x in ranked]
        self.automaton = ahocorasick.Automaton()
        for token, k in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.special = special
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(pattern)
        self.known, self.good = np.array([-1], np.int64), np.array([False])
        self._memo: dict[str, bytes] = {}
        self.exact_words = self.all_words = 0

    # -- exact merging -----------------------------------------------------

    def merged(self, word: bytes) -> list[int]:
        """Merges by rank, the leftmost first, with a heap over a linked list."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.merges[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i] = self.merges[left, right][1]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in self.merges:
                heapq.heappush(heap, (self.merges[p][0], h, *p))
        return [x for x, ok in zip(ids, alive) if ok]

    def merged_batch(self, words: list[bytes]) -> list[list[int]]:
        """The same for many short words at once: every round merges the best pair
        of each word, in arrays of one row a word."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > LOCKSTEP_BYTES:
                out[k] = self.merged(word)
            else:
                by_size.setdefault(len(word), []).append(k)
        for size, own in by_size.items():
            if not size:
                continue
            ids = np.array(self.single, np.int64)[np.frombuffer(b"".join(words[k] for k in own), np.uint8).reshape(-1, size)]
            live, rank = np.array(own), self._rank(ids[:, :-1], ids[:, 1:])
            while ids.shape[1] > 1:
                at = rank.argmin(1)
                rows = np.arange(len(ids))
                best = rank[rows, at]
                done = best == NO_RANK
                if done.any():
                    for k, x in zip(live[done].tolist(), ids[done].tolist()):
                        out[k] = x
                    ids, rank, live, at, best = ids[~done], rank[~done], live[~done], at[~done], best[~done]
                    if not len(ids):
                        break
                    rows = np.arange(len(ids))
                width = ids.shape[1] - 1
                take = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
                ids = np.take_along_axis(ids, take, 1)
                ids[rows, at] = self.merge_result[best]
                rank = np.take_along_axis(rank, np.minimum(take[:, :-1], rank.shape[1] - 1), 1)
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < width - 1)
                    r, c = rows[ok], side[ok]
                    rank[r, c] = self._rank(ids[r, c], ids[r, c + 1])
            for k, x in zip(live.tolist(), ids.tolist()):
                out[k] = x
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left * self.base + right
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == codes, self.merge_ranks[at], NO_RANK)

    # -- speculation and verification --------------------------------------

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches against the vocabulary for all words in one pass
        of the automaton: the ids, and how many each word has."""
        ends, ids = [], []
        for end, token in self.automaton.iter_long(GAP.join(word.decode("latin-1") for word in words)):
            ends.append(end)
            ids.append(token)
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        of = np.searchsorted(last, np.array(ends, np.int64), side="left")
        return np.array(ids, np.int64), np.bincount(of, minlength=len(words))

    def fits(self, codes: np.ndarray) -> np.ndarray:
        """For each code left * (base + 1) + right: would merging the two tokens'
        joined bytes give just these two? With ``base`` for right (no token): is the
        token its own encoding?"""
        own, back = np.unique(codes, return_inverse=True)
        if len(self.known) > KNOWN_PAIRS:
            self.known, self.good = self.known[:1], self.good[:1]
        new = own[~np.isin(own, self.known, assume_unique=True)]
        if len(new):
            pairs = [divmod(code, self.base + 1) for code in new.tolist()]
            joined = [self.bytes_of[left] + (self.bytes_of[right] if right < self.base else b"") for left, right in pairs]
            good = [ids == ([left, right] if right < self.base else [left]) for ids, (left, right) in zip(self.merged_batch(joined), pairs)]
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.known, self.good = known[order], np.concatenate([self.good, good])[order]
        return self.good[np.searchsorted(self.known, own)][back]

    def encoded_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, and how many each has: proposals are tested pair by
        pair in one array; only words with a pair that doesn't fit are merged."""
        flat, sizes = self.proposed(words)
        if not any(words):
            return flat, sizes
        ends = np.cumsum(sizes)
        follower = np.full(len(flat), self.base, np.int64)
        follower[:-1] = flat[1:]
        last = np.zeros(len(flat), bool)
        last[ends[sizes > 0] - 1] = True
        follower[last] = self.base
        tested = ~last | np.repeat(sizes == 1, sizes)  # the last token alone only where it is the whole word
        good = np.ones(len(flat), bool)
        good[tested] = self.fits(flat[tested] * (self.base + 1) + follower[tested])
        of = np.repeat(np.arange(len(words)), sizes)
        wrong = np.bincount(of, ~good, len(words)) > 0
        wrong |= np.bincount(of, self.token_size[flat], len(words)) != np.fromiter(map(len, words), np.int64, len(words))  # not all bytes proposed
        bad = np.flatnonzero(wrong)
        self.all_words += len(words)
        self.exact_words += len(bad)
        if not len(bad):
            return flat, sizes
        exact = self.merged_batch([words[k] for k in bad.tolist()])
        # put the merged words' ids behind the proposals and gather in word order
        starts = ends - sizes
        pool = np.concatenate([flat, np.fromiter((t for x in exact for t in x), np.int64)])
        lengths = np.fromiter(map(len, exact), np.int64, len(exact))
        starts[bad] = len(flat) + np.cumsum(lengths) - lengths
        sizes = sizes.copy()
        sizes[bad] = lengths
        return pool[_ragged(starts, sizes)], sizes

    def _encoded_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of distinct parts. Parts that begin with a space and end visibly are
        split into words together; the few others one by one."""
        joint, rest = [], []
        for part in parts:
            special = self.special_at is not None and self.special_at.search(part)
            (joint if self.cuts and part[0] == " " and not part[-1].isspace() and not special else rest).append(part)
        words = self.words.findall("".join(joint))
        counts = np.bincount(
            np.searchsorted(np.cumsum(np.fromiter(map(len, joint), np.int64, len(joint))), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), side="left"),
            minlength=len(joint),
        ).tolist() if joint else []
        for part in rest:
            at, n = 0, len(words)
            for m in self.special_at.finditer(part) if self.special_at else ():
                words += self.words.findall(part[at : m.start()])
                words.append(self.special[m.group()])
                at = m.end()
            words += self.words.findall(part[at:])
            counts.append(len(words) - n)
        place = {word: k for k, word in enumerate(dict.fromkeys(words))}
        plain = [b"" if isinstance(word, int) else word.encode() for word in place]
        ids, sizes = self.encoded_words(plain)
        starts = np.cumsum(sizes) - sizes
        for word, k in place.items():
            if isinstance(word, int):
                starts[k], sizes[k] = len(ids), 1
                ids = np.append(ids, word)
        of = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        blob = ids[_ragged(starts[of], sizes[of])].astype("<u4").tobytes()
        word_ends = np.concatenate([[0], np.cumsum(sizes[of])]) * 4
        part_ends = word_ends[np.cumsum(np.array(counts, np.int64))].tolist()
        return {part: blob[a:b] for part, a, b in zip(joint + rest, [0, *part_ends], part_ends)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(own) for own in in_groups(texts, self._encode_group)]

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """Parts that repeat are remembered, up to a bound; the others only for this call."""
        rows = [cut(text) if self.cuts else [text] * bool(text) for text in texts]
        memo = self._memo
        seen = Counter(part for row in rows for part in row if part not in memo)
        if not seen:
            return [b"".join(map(memo.__getitem__, row)) for row in rows]
        room = max(0, MEMO_PARTS - len(memo))
        stay = {part for part, n in seen.items() if n > 1 and len(part) <= MEMO_CHARS}
        memo.update(self._encoded_parts(list(seen)))
        out = [b"".join(map(memo.__getitem__, row)) for row in rows]
        for part in seen:
            if part not in stay or room <= 0:
                del memo[part]
            else:
                room -= 1
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; special tokens are kept, broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _per_text(df: DataFrame, step: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    names = [column.split()[0] for column in schema.split(", ")]
    return map_batches(df, lambda batch: pa.RecordBatch.from_arrays(step(batch), names), schema)


def encode(df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, ids (binary: little-endian unsigned 32-bit).

    Each batch's distinct words get greedy longest-match proposals; an array test
    of all adjacent token pairs (a pair fits if exact merging of the joined bytes
    gives the pair) accepts most, and the rest are merged exactly. Where every
    adjacent pair fits, the proposal is the exact encoding. Nulls and empty texts give no ids. A null id stays
    null, repeated rows give repeated results, other columns are ignored, an empty table gives an
    empty result.
    """

    def step(batch):
        ids = vocabulary(vocabulary_path, pattern).encode_batch(batch.column(1).to_pylist())
        return [batch.column(0), pa.array(ids, pa.binary())]

    return _per_text(texts_of(df, id_col, text_col), step, "doc_id long, ids binary")


def decode(df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: doc_id, text. Null ids give an empty text; an empty table gives an empty result."""

    def step(batch):
        own = vocabulary(vocabulary_path, pattern)
        return [batch.column(0), pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())]

    return _per_text(df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")), step, "doc_id long, text string")


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes from the ids, and returns the digests of both:
    doc_id, n_tokens, ids_sha256, decoded_sha256. Cases as in ``encode``."""

    def step(batch):
        own = vocabulary(vocabulary_path, pattern)
        ids = own.encode_batch(batch.column(1).to_pylist())
        return [
            batch.column(0),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _per_text(texts_of(df, id_col, text_col), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
