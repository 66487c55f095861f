"""Static binary-fuse filter over 64-bit keys: 8-bit fingerprints, three probes, about 9 bits a key.

Built once for a set of distinct keys and never changed. Peeling goes in rounds: all slots that one key alone
still uses are released together, and fingerprints are set in the reverse order of the rounds.
"""

from __future__ import annotations

import math

import numpy as np

MAX_SEEDS = 100


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (shift, multiply, shift) of key plus seed."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots per key, in three consecutive segments."""
    start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = start.astype(np.int64) * segment
    within = np.uint64(segment - 1)
    first = base + (h & within).astype(np.int64)
    second = base + segment + ((h >> np.uint64(18)) & within).astype(np.int64)
    third = base + 2 * segment + (((h >> np.uint64(9)) ^ (h >> np.uint64(41))) & within).astype(np.int64)
    return np.stack([first, second, third])


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(37))).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of the distinct ``keys``."""
    keys = np.unique(np.asarray(keys, dtype=np.int64)).view(np.uint64)
    n = len(keys)
    segment = 1 << max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for attempt in range(MAX_SEEDS):
        seed = 0x9E3779B97F4A7C15 * (attempt + 1) & (2**64 - 1)
        h = _mix(keys, seed)
        slots = _slots(h, segment, segments)
        size = segment * (segments + 2)
        order = _peel(slots, n, size)
        if order is not None:
            table = np.zeros(size, dtype=np.uint8)
            prints = _prints(h)
            for which, at in reversed(order):
                value = prints[which] ^ table[slots[0, which]] ^ table[slots[1, which]] ^ table[slots[2, which]]
                table[at] = value ^ table[at]
            return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter")


def _peel(slots: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their slots), or None if some keys hold each other."""
    count = np.bincount(slots.ravel(), minlength=size)
    mark = np.zeros(size, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(mark, row, np.arange(n))
    rounds, left = [], n
    free = np.flatnonzero(count == 1)
    while len(free):
        which, first = np.unique(mark[free], return_index=True)
        rounds.append((which, free[first]))
        left -= len(which)
        for row in slots:
            np.subtract.at(count, row[which], 1)
            np.bitwise_xor.at(mark, row[which], which)
        touched = np.unique(slots[:, which])
        free = touched[count[touched] == 1]
    return rounds if left == 0 else None


def contains(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """False: surely not in the set. True: in it, or one of about 1 in 256 others."""
    h = _mix(np.asarray(keys, dtype=np.int64).view(np.uint64), seed)
    stored = np.frombuffer(table, dtype=np.uint8)
    first, second, third = _slots(h, segment, segments)
    return (stored[first] ^ stored[second] ^ stored[third]) == _prints(h)
