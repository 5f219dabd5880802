"""Words and shingles of many texts at once, on the bytes of a batch.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return. Words and shingles are compared by 64-bit hashes: a polynomial over random byte values
(from running sums, so no loop over words), then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: The same, with A-Z as a-z.
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def running_hash(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Sums from which span_hash gets the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them (and the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~is_space(data)
    edges = at[(at > 0) & (at < len(data))]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingles(data: np.ndarray, at: np.ndarray, size: int,
             lower: bool = False) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text with fewer words than ``size`` has
    its whole sequence as one shingle; one without words has none."""
    starts, ends, bounds = word_spans(data, at)
    words = span_hash(running_hash(data, LOWER if lower else BYTES), starts, ends)
    many = max(len(words) - size + 1, 0)
    runs = np.zeros(many, np.uint64)
    for k in range(size):
        runs += words[k:k + many] * STEPS[k]
    runs = mix(runs)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo:hi - size + 1]))
        elif hi > lo:
            whole = (words[lo:hi] * STEPS[:hi - lo]).sum(dtype=np.uint64) + U(hi - lo)
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    where = np.searchsorted(b, a)
    where[where == len(b)] = max(len(b) - 1, 0)
    return int((b[where] == a).sum()) if len(b) else 0
