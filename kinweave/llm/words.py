"""Words and hashes of whole texts, over the bytes of Arrow columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 these bytes never occur inside a character.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one entry more than rows)."""
    n = len(data)
    space = SPACE[data]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = space
    before[offsets] = True
    after = before[1:].copy()
    starts = np.flatnonzero(~space & before[:-1])
    # the byte after a word is a space, or the next row begins there
    after[:] = False
    after[:-1] = space[1:]
    cut = offsets[(offsets > 0) & (offsets <= n)] - 1
    after[cut] = True
    if n:
        after[-1] = True
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of prefix sums of a polynomial, mixed."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + limit, "right")))
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * powers(_BASE, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * powers(_INVERSE, high - low + 1)[s]
        at = to
    return mix(out)


def second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another hash of each span, with byte values of its own."""
    return mix(hash_spans(data, starts, ends, table=_OTHER) ^ np.uint64(_BASE))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes; len(words) - width + 1 of them (none if fewer)."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if width <= 8:
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out += words[k : k + n] * _STEP[k]
        return mix(out)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_INVERSE, n))


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a sequence of hashes."""
    n = len(values)
    a = int((values * powers(_BASE, n)).sum(dtype=np.uint64)) if n else 0
    b = int((mix(values) * powers(int(_STEP[9]), n)).sum(dtype=np.uint64)) if n else 0
    signed = np.array([a ^ n, b + n & (1 << 64) - 1], np.uint64).view(np.int64)
    return int(signed[0]), int(signed[1])
