"""Static binary-fuse filters: about nine bits a key, no false negatives."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = (1 << 64) - 1


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed * int(_ODD) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _layout(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for ``n`` keys."""
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(np.ceil(n * factor)) // segment) - 2)
    return segment, count


def _cells(h: np.ndarray, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells for each hash, in three neighbouring segments; and fingerprints."""
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    first = first.astype(np.int64)
    low = segment - 1
    second = (first + segment) ^ ((h >> np.uint64(18)) & np.uint64(low)).astype(np.int64)
    third = (first + 2 * segment) ^ (h & np.uint64(low)).astype(np.int64)
    return np.stack([first, second, third]), ((h ^ (h >> np.uint64(40))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, bytes]:
    """Seed and table of the filter of ``keys`` (unsigned 64-bit, repeats allowed).

    Peeling in rounds: every cell that a single key still uses fixes that key. If
    keys are left over, the next seed is tried, and every tenth try gets more room.
    """
    keys = np.unique(np.asarray(keys, np.uint64))
    if not len(keys):
        return 0, b""
    for seed in range(1, 1000):
        segment, count = _layout(int(len(keys) * (1 + 0.1 * (seed // 10))))
        cells, prints = _cells(_mixed(keys, seed), segment, count)
        size = (count + 2) * segment
        degree = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in cells:
            owner ^= _xor_by(row, np.arange(len(keys)), size)
        alive = np.ones(len(keys), bool)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            who, at = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[at]))
            alive[who] = False
            for row in cells[:, who]:
                degree -= np.bincount(row, minlength=size)
                owner ^= _xor_by(row, who, size)
        if alive.any():
            continue
        table = np.zeros(size, np.uint8)
        for who, at in reversed(rounds):
            a, b, c = cells[:, who]
            table[at] = prints[who] ^ table[a] ^ table[b] ^ table[c] ^ table[at]
        return seed, table.tobytes()
    raise ValueError("no seed was found for the filter")


def _xor_by(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.bitwise_xor.at(out, cells, values)
    return out


def contains(keys: np.ndarray, n: int, seed: int, table: bytes) -> np.ndarray:
    """For each key: may it be among the ``n`` distinct ones that were built in?"""
    keys = np.asarray(keys, np.uint64)
    if not table:
        return np.zeros(len(keys), bool)
    cells_of = np.frombuffer(table, np.uint8)
    segment, count = _layout(int(n * (1 + 0.1 * (seed // 10))))
    cells, prints = _cells(_mixed(keys, seed), segment, count)
    return (cells_of[cells[0]] ^ cells_of[cells[1]] ^ cells_of[cells[2]]) == prints
