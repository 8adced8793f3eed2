"""Words, lines and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Hashes have 64 bits: a polynomial over random
values of the bytes (or words), then mixed, so that equal words have equal hashes in every task."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_Q = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E6C63D0876A9A47)
    h ^= h >> np.uint64(32)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _P), np.full(n, _P_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes; the spans stand in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a, step = 0, 1 << 20
    while a < len(starts):  # a bounded stretch of bytes at once, at least one span
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, side="right")))
        at, to = int(starts[a]), int(ends[b - 1])
        up, down = _pow(max(to - at + 1, 1024))
        sums = np.empty(to - at + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[buf[at:to]] * up[: to - at], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - at] - sums[starts[a:b] - at]) * down[starts[a:b] - at]
        a = b
    return mix(out ^ (ends - starts).astype(np.uint64))


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses the start of a document."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(flag)]
    first[inner] |= flag[inner]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    inner = inner[inner > 0]
    last[inner - 1] |= flag[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a slice: byte spans, hashes, and word_offsets (where each document's words begin)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        buf = LOWER[buf] if lower else buf
        self.starts, self.ends = runs(~SPACE[buf], offsets)
        self.offsets = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.offsets)
        self.hashes = span_hashes(buf, self.starts, self.ends) if hashes else None

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words; those that cross documents are for the caller to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= _Q
        out += hashes[j : j + n]
    return mix(out)


def window_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[starts:ends] for many spans at once."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups equal hashes of one document: (order, group of each sorted place, size of each group).
    Inside a group the places stand in their old order."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(doc) and doc[-1] < 65536 else np.int64), kind="stable")]
    if not len(order):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, h = doc[order], hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(first) - 1
    return order, group, np.bincount(group)


def in_doc(words: Words, size: int) -> np.ndarray:
    """True where ``size`` consecutive words from here lie in one document (for the places of shingles())."""
    doc = words.doc()
    n = max(0, len(doc) - size + 1)
    return doc[:n] == doc[size - 1 : size - 1 + n]


def byte_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each document has each byte: (documents, 256)."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount((doc << 8) | buf, minlength=256 * (len(offsets) - 1)).reshape(-1, 256)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty lines (split at \n alone)."""
    return runs(buf != 10, offsets)
