"""Cutting of texts at places where byte-level BPE can be cut safely.

The vocabulary's split pattern makes words of one class each (letters, digits, marks), with
at most one space in front, and of white space. So a text may be cut before any
white space whose left neighbour is visible. In text without white space it may also be
cut behind a letter or digit that another class follows, and between a mark and a
digit, but not between a mark and a letter (``'s`` is a word) nor inside a special string. The
tokens of the parts are the tokens of the whole. A run of one class has no such place: the
pattern makes it a single word, however long.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TypeVar

import regex

T = TypeVar("T")

#: White space before a space: there the simple cut at each space isn't safe.
_RUN = re.compile(r"\s ")
_SPACE = re.compile(r"(?<=\S)(?= )")
_BLANK = re.compile(r"(?<=\S)(?=\s)")
_CLASS = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
SPECIAL = ("<|endoftext|>",)


def cuttable(spec: dict) -> bool:
    """Is the split pattern of a tokenizer file the one whose safe places ``cut`` knows?"""
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain) and not spec.get("normalizer") and all(t["content"] in SPECIAL and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)


def cut(text: str) -> list[str]:
    """Parts of ``text``, in order; each but the first begins with its space."""
    if not text:
        return []
    if _RUN.search(text):
        return _SPACE.split(text)
    if text[0] == " ":
        return [" " + part for part in text.split(" ")[1:]]
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


def _place(text: str, at: int, most: int, special: tuple[str, ...]) -> int | None:
    """The first safe place from ``at`` on: before white space, or else, if there is none
    within ``most`` characters, between classes."""
    blank = _BLANK.search(text, at, min(len(text), at + most + 1))
    if blank:
        return blank.start()
    for m in _CLASS.finditer(text, at):
        k = m.start()
        if not any(s in text[max(0, k - len(s) + 1) : k + len(s) - 1] for s in special):
            return k
    blank = _BLANK.search(text, at)
    return blank.start() if blank else None


def slices(text: str, most: int = 1 << 20, special: tuple[str, ...] = SPECIAL) -> list[str]:
    """``text`` cut at safe places into slices of about ``most`` characters, so that a
    very long text is never held as parts all at once. Most texts are one slice."""
    out, at = [], 0
    while len(text) - at > most and (place := _place(text, at + most, most, special)) is not None:
        out.append(text[at:place])
        at = place
    return [*out, text[at:]]


def in_groups(texts: list[str], work: Callable[[list[str]], list[T]], most: int = 2 << 20) -> list[list[T]]:
    """``work`` on the slices of all texts, in groups of about ``most`` characters; for
    each text the results of its slices, in order."""
    out: list[list[T]] = [[] for _ in texts]
    group: list[str] = []
    owners: list[int] = []
    held = 0
    for k, text in enumerate(texts):
        for part in slices(text):
            group.append(part)
            owners.append(k)
            held += len(part)
            if held >= most:
                for owner, result in zip(owners, work(group)):
                    out[owner].append(result)
                group, owners, held = [], [], 0
    for owner, result in zip(owners, work(group)):
        out[owner].append(result)
    return out


def packed(parts: list[str], most_bytes: int) -> list[list[str]]:
    """Groups of parts with about as many bytes each, ``most_bytes`` at most unless
    a single part is larger: the longest first, so that no group is far from full."""
    groups: list[list[str]] = []
    room = 0
    for part in sorted(parts, key=len, reverse=True):
        size = len(part.encode("utf-8", "surrogatepass")) + 1
        if not groups or size > room:
            groups.append([])
            room = most_bytes
        groups[-1].append(part)
        room -= size
    return groups
