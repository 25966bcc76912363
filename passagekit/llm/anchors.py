"""Winnowed anchors over symbol sequences (bytes or words).

Every window of ``width`` symbols owns the anchor with the smallest hash among
its ``k``-grams (leftmost on ties), so equal windows own equal anchors at equal
offsets. Consecutive windows with one anchor form a *run*; a run is described by
its anchor hash and a 128-bit digest of all its symbols, which is enough to find
repeats without shipping text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CHUNK = 1 << 17              # symbols per vectorised pass: its arrays fit a core's cache
MAX_WIDTH = 256              # digests modulo 2^64 tell runs (under twice a window) of this size apart;
                             # from 1,024 symbols on there are sequences that they never do
_U = np.uint64
# Fixed odd multipliers of the two polynomial digests (any odd values do).
M1, M2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of uint64 values (in place on a copy)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=4)
def _powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``m**i`` and ``m**-i`` modulo 2**64 for i below n."""
    up, down = np.full(n, m, _U), np.full(n, pow(m, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


class Digest:
    """Prefix digests of one chunk; any span's digest in constant time."""

    def __init__(self, h: np.ndarray, m: int, cap: int):
        up, self.down = _powers(m, cap)
        self.p = np.zeros(len(h) + 1, _U)
        np.cumsum(h * up[:len(h)], out=self.p[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.p[end] - self.p[start]) * self.down[start]


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = np.minimum(x[:len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have:w - have + n])


class Runs:
    """Runs of one chunk: arrays ``anchor, start, count, f1, f2, doc``.

    ``h1``/``h2``: symbol hashes (two independent uint64 arrays); ``ends``:
    for each document of the chunk its end in symbols (documents lie one after
    the other); ``width``: window length; ``k``: symbols of an anchor.
    """

    def __init__(self, h1, h2, ends, width: int, k: int):
        if width > MAX_WIDTH:
            raise ValueError(f"windows of over {MAX_WIDTH} symbols")
        n, cap = len(h1), CHUNK + (1 << 12)
        cap = max(cap, 1 << (n + 1).bit_length()) if n + 1 > cap else cap
        self.width, self.d1, self.d2 = width, Digest(h1, M1, cap), Digest(h2, M2, cap)
        e = np.zeros(0, np.int64)
        self.anchor = self.f1 = self.f2 = self.start = self.count = self.doc = e
        if n < width:
            return
        at = np.arange(n - k + 1)
        g = mix(self.d1(at, at + k))
        low = (g & _U(_MASK ^ 0xFFFFFF)) | at.astype(_U)     # ties: leftmost
        best = (slide_min(low, width - k + 1) & _U(0xFFFFFF)).astype(np.int64)
        ends = np.asarray(ends, np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[:n - width + 1]
        ok = np.flatnonzero(np.arange(n - width + 1) + width <= ends[doc])
        if not len(ok):
            return
        b, d = best[ok], doc[ok]
        cut = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1])])
        self.start = ok[cut]
        self.count = np.diff(np.r_[cut, len(ok)])
        self.doc = d[cut]
        p = b[cut]
        self.anchor = g[p].astype(np.int64)
        end = self.start + self.count - 1 + width
        salt = (p - self.start).astype(_U) * _U(M2) + self.count.astype(_U) * _U(M1)
        self.f1 = mix(self.d1(self.start, end) + salt).astype(np.int64)
        self.f2 = mix(self.d2(self.start, end) ^ salt).astype(np.int64)

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the windows at ``start``."""
        end = start + self.width
        return mix(self.d1(start, end)).astype(np.int64), mix(self.d2(start, end)).astype(np.int64)


def chunks(lengths, width: int):
    """Cut documents into vectorised passes.

    Yields lists of ``(doc index, from, to)`` of at most about ``CHUNK``
    symbols. A longer document is cut at fixed multiples of ``CHUNK`` window
    starts, with ``width - 1`` symbols of overlap, so every window lies whole in
    exactly one piece. Documents shorter than a window are skipped.
    """
    out, size = [], 0
    for i, n in enumerate(lengths):
        n = int(n)
        for a in range(0, max(0, n - width + 1), CHUNK):
            b = min(n, a + CHUNK + width - 1)
            if size and size + b - a > CHUNK:
                yield out
                out, size = [], 0
            out.append((i, a, b))
            size += b - a
    if out:
        yield out


def spread_runs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window start of the given runs, and the index of its run."""
    which = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    return start[which] + (np.arange(len(which)) - first[which]), which


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal disjoint spans (touching ones join)."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    if not len(s):
        return s, e
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[cut], e[np.r_[cut[1:] - 1, len(e) - 1]]
