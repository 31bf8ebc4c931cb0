"""Vectorised text features: word hashes, shingles and character n-grams of whole Arrow batches."""

from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and the powers of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of consecutive texts, and each text's first word.

    data: UTF-8 bytes; offsets: where texts begin and end; space: other bytes that end words. The second result has one
    more entry than texts.
    """
    first = np.zeros(len(offsets), np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), first
    space = space[data]
    begin = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(begin & (np.r_[True, space[:-1]] | edge[:-1]))
    ends = np.flatnonzero(begin & (np.r_[space[1:], True] | edge[1:])) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of whole words, so that temporaries stay small for any text
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + _PIECE, side="right")))
        hi = ends[to - 1]
        up, down = _power(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * M2)
        at = to
    first[:] = np.searchsorted(starts, offsets)
    return out, first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each text the sorted distinct hashes of its `width`-word shingles.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words, first = word_hashes(data, offsets)
    seeds = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(words)
    runs = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        if len(runs):
            runs += words[k : n - width + 1 + k] * seeds[k]
    runs = mix(runs)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix((words[a:b] * seeds[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


_tables: dict[str, np.ndarray] = {}


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with everything but letters turned into spaces, and the texts' offsets in them."""
    if not _tables:
        low = np.full(0x110000, 32, np.uint32)
        for i in range(0x32400):  # there are no letters beyond the third ideographic plane
            c = chr(i)
            if c.isalpha():
                low[i] = ord(c.lower()) if len(c.lower()) == 1 else i
        _tables["low"] = low
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return _tables["low"][code], starts[offsets]


def raw_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as they stand, and the texts' offsets in them."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return code, np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]


def gram_buckets(code: np.ndarray, orders: range, bits: int):
    """(order, bucket of the n-gram that begins at each place) for each order; the last order - 1 places have none."""
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(orders) + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + (code[n - 1 :] ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)
        if n in orders:
            x = h ^ (h >> np.uint32(15))
            yield n, ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32)


def hashed_counts(code: np.ndarray, offsets: np.ndarray, orders: range, bits: int) -> np.ndarray:
    """Rows of square roots of relative n-gram frequencies in 2**bits buckets, one row for each text."""
    n, size = len(offsets) - 1, 1 << bits
    out = np.zeros((n, size), np.float32)
    for order, bucket in gram_buckets(code, orders, bits):
        for i in range(n):
            a, b = offsets[i], offsets[i + 1] - order + 1
            if b > a:
                out[i] += np.bincount(bucket[a:b], minlength=size)
    total = out.sum(1, keepdims=True)
    np.divide(out, total, out=out, where=total > 0)
    return np.sqrt(out, out=out)
