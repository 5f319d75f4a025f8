"""Words of many texts at once, found and hashed as arrays of bytes."""

from __future__ import annotations

import numpy as np

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
_OTHER = np.uint64(0xD6E8FEB86659FD93 | 1)
_CHUNK = 1 << 20

#: Byte classes. Bytes of 128 and more belong to characters that are no ASCII, all of them part of words.
LETTERS = np.array([c >= 128 or chr(c).isalnum() and c < 128 and chr(c).isascii() for c in range(256)])
NOT_SPACE = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(x: np.uint64) -> np.uint64:
    y = int(x)
    for _ in range(6):
        y = y * (2 - int(x) * y) & (1 << 64) - 1
    return np.uint64(y)


_powers_of: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers_of.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * _CHUNK:
            _powers_of[int(base)] = have
    return have[:n]


def find(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Start, end and row of every longest run of bytes of ``kind`` inside a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    inverse = _inverse(base)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK)))
        a, b = int(starts[i]), int(ends[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * powers(base, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * powers(inverse, b - a)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Hashes of the first bytes of each run: a column for each length, and one for the whole run; 0 where it is too short."""
    out = np.zeros((len(starts), len(lengths) + 1), np.uint64)
    inverse, i = _inverse(_BASE), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK)))
        a, b = int(starts[i]), int(ends[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * powers(_BASE, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        back, head = powers(inverse, b - a)[s], total[s]
        for k, n in enumerate(lengths):
            f = np.minimum(s + n, e)
            out[i:j, k] = np.where(e - s > n, mix((total[f] - head) * back + np.uint64(n << 32)), 0)
        out[i:j, -1] = mix((total[e] - head) * back + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(values: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A hash of each ``n`` consecutive values; whether they are of one row is for the caller to see."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    step = _OTHER if second else _STEP
    if n <= 8:
        out = np.zeros(len(values) - n + 1, np.uint64)
        for k in range(n):
            out = out * step + values[k:len(values) - n + 1 + k]
        return mix(out)
    inverse, out = _inverse(step), np.empty(len(values) - n + 1, np.uint64)
    for a in range(0, len(out), _CHUNK):
        b = min(len(out), a + _CHUNK)
        total = np.zeros(b - a + n, np.uint64)
        np.cumsum(values[a:b + n - 1] * powers(step, b - a + n - 1), out=total[1:])
        out[a:b] = (total[n:n + b - a] - total[:b - a]) * powers(inverse, b - a)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
