"""Vectorised helpers shared by the operators that look for long repeats.

A *unit* is a byte or a word; a batch of texts is one long array of units with
document offsets.  Every window of ``width`` units is assigned to exactly one
*anchor* inside it, chosen from the window's own content, so equal windows in
different places always have anchors with equal names at equal offsets.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the prefix hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective, nonlinear 64-bit scramble (finaliser of a splitmix generator)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept and grown between batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, U(base & (2**64 - 1)), dtype=U)
        steps[0] = U(1)
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


class PrefixHash:
    """Prefix polynomial hashes of a symbol array: any slice's hash in O(1)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(symbols * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(BASE_INV, n + 1)

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of ``symbols[start:stop]``, elementwise; lengths are not mixed in."""
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all slices of one width."""
        if len(self.sums) <= width:
            return np.zeros(0, dtype=U)
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each byte."""
    return mix((np.arange(256, dtype=U) + U(1)) * U(0xD6E8FEB86659FD93))[data]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive items, by block prefixes and suffixes."""
    n = len(x)
    if n < width:
        return x[:0]
    if width == 1:
        return x
    pad = -n % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]) if pad else x
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def elect(order: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Assign every window of ``width`` units to the least gram in it.

    ``order[i]`` ranks the gram ``units[i:i+gram]`` and depends on that gram
    alone.  Returns (anchor, first, last): the windows that start at
    first..last, inclusive, have this gram, the leftmost of the least ones.
    """
    none = np.zeros(0, dtype=np.int64)
    span = width - gram + 1
    if len(order) < span:
        return none, none, none
    place = np.arange(len(order), dtype=U)
    least = sliding_min((order & U(0xFFFFFFFF00000000)) | place, span)
    chosen = (least & U(0xFFFFFFFF)).astype(np.int64)
    # A window is valid if it ends within the document in which it starts.
    starts, stops = offsets[:-1], offsets[1:]
    long = stops - starts >= width
    starts, stops = starts[long], stops[long] - width + 1
    if not len(starts):
        return none, none, none
    edge = np.zeros(len(chosen) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(stops, len(chosen)), -1)
    valid = np.cumsum(edge[:-1]) > 0
    change = np.ones(len(chosen), dtype=bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    ends = np.ones(len(chosen), dtype=bool)
    ends[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(ends & valid)
    return chosen[first], first, last


def widest(rank: np.ndarray, low: np.ndarray, high: np.ndarray, offsets: np.ndarray, width: int):
    """Assign every window of ``width`` units to the symbol of the highest rank (32 bits) whose
    region low..high - 1 is inside it; the first of equal ones.  Returns (symbol, first, last).

    Symbol k is inside the windows high[k] - width..low[k]: the maximum over these ranges is
    taken by two overlapping power-of-two blocks for each and pushed down.
    """
    n = int(offsets[-1])
    none = np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero((low >= 0) & (high <= n))
    of = doc[low[inside]]
    left = np.maximum(high[inside] - width, offsets[of])
    right = np.minimum(low[inside], offsets[of + 1] - width)
    able = np.flatnonzero(left <= right)
    left, right, inside = left[able], right[able], inside[able]
    if not len(inside):
        return none, none, none
    full = rank[inside] << U(32) | U(0xFFFFFFFF) - inside.astype(U)
    power = np.frexp((right - left + 1).astype(float))[1] - 1
    best = None
    for p in range(int(power.max()), -1, -1):
        level = np.zeros(n, dtype=U)
        if best is not None:
            np.maximum(level, best, out=level)
            half = 1 << p
            np.maximum(level[half:], best[: n - half], out=level[half:])
        k = np.flatnonzero(power == p)
        np.maximum.at(level, left[k], full[k])
        np.maximum.at(level, right[k] - (1 << p) + 1, full[k])
        best = level
    valid = best > 0
    change = np.ones(n, dtype=bool)
    change[1:] = best[1:] != best[:-1]
    ends = np.ones(n, dtype=bool)
    ends[:-1] = change[1:]
    first, last = np.flatnonzero(change & valid), np.flatnonzero(ends & valid)
    return (U(0xFFFFFFFF) - (best[first] & U(0xFFFFFFFF))).astype(np.int64), first, last
