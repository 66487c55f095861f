"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of a text at once.

A word's hash is the sum of a random number per byte times a power of an odd base by position, modulo 2 ** 64,
taken from running sums; shingles combine the mixed hashes of their words. Different shingles meet with a chance of
about 2 ** -64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
#: Bytes that are hashed at once, a bound on memory unless a single word is longer.
PIECE = 1 << 16
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a long text in pieces that end between words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found, at = [], 0
    while at < len(data):
        end, step = len(data), PIECE
        while at + step < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[at : at + step]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            step *= 2
        found.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return _mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of all ``k``-word shingles; with fewer words, of the whole sequence as one."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for j in range(width):
            total = _mix(total + words[j : n - width + 1 + j] * _PLACE[j % len(_PLACE)])
    return np.unique(total)


def fingerprint(values: np.ndarray) -> bytes:
    """128-bit name of an array of hashes."""
    return hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()
