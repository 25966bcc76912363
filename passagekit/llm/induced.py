"""Suffix sorting by external induced sorting.

The suffixes that start a local descent's end (leftmost S-type, "LMS") are
sorted by recursion on the string of their names; all others follow by
induction: visiting suffixes in order, each one hands its left neighbour to a
priority queue keyed by that neighbour's symbol. Induced suffixes of one symbol
arrive in their final order, so the queue keeps a first-in-first-out list per
batch of symbols and moves the lists to files when they exceed ``memory``
entries. Larger alphabets (the names of deeper levels) are visited in batches of
symbols; inside a batch the order follows by doubling along chains of neighbours.
"""

from __future__ import annotations

import os

import numpy as np

from .anchors import M1, M2, Digest, mix

MEMORY = 1 << 20             # queue entries (16 bytes each) kept in memory


class Tape:
    """Append-only sequence of positions, on disk beyond ``memory`` entries."""

    def __init__(self, folder: str, name: str, memory: int):
        self.path, self.memory, self.parts, self.size, self.stored = os.path.join(folder, name), memory, [], 0, 0

    def add(self, x: np.ndarray) -> None:
        if len(x):
            self.parts.append(x)
            self.size += len(x)
            if self.size > self.memory:
                self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as f:
            for p in self.parts:
                p.astype(np.int64).tofile(f)
        self.stored, self.parts, self.size = self.stored + self.size, [], 0

    def take(self) -> np.ndarray:
        """All entries; the file is removed."""
        out = self.parts
        if self.stored:
            out = [np.fromfile(self.path, np.int64), *out]
            os.remove(self.path)
        self.parts, self.size, self.stored = [], 0, 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class InductionQueue:
    """Priority queue over symbols, visited batch by batch in ascending order."""

    def __init__(self, batch_of: np.ndarray, folder: str, name: str, memory: int):
        self.batch_of = batch_of.astype(np.uint16) if len(batch_of) and batch_of.max() < 1 << 16 else batch_of
        self.folder, self.name, self.memory = folder, name, memory
        self.lists: dict[int, Tape] = {}
        self.held = 0

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        b = self.batch_of[symbols]
        order = np.argsort(b, kind="stable")        # 16-bit numbers are sorted by digits
        b, positions = b[order], positions[order]
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        for at, part in zip(np.r_[0, cuts].tolist(), np.split(positions, cuts), strict=True):
            k = int(b[at])
            if k not in self.lists:
                self.lists[k] = Tape(self.folder, f"{self.name}-{k}", 1 << 62)
            self.lists[k].add(part)
        self.held += len(positions)
        if self.held > self.memory:
            for t in self.lists.values():
                t.flush()
            self.held = 0

    def pop(self, batch: int) -> np.ndarray:
        t = self.lists.pop(batch, None)
        if t is None:
            return np.zeros(0, np.int64)
        self.held -= t.size
        return t.take()


def _batches(x: np.ndarray, k: int, memory: int):
    """Symbols in batches: one each for small alphabets, else ranges of symbols
    with about ``memory`` suffixes."""
    if k <= 512:
        return np.arange(k), [(s, s + 1) for s in range(k)]
    count = np.bincount(x, minlength=k)
    batch_of = (np.cumsum(count) - count) // max(1, memory)
    _, batch_of = np.unique(batch_of, return_inverse=True)
    ends = np.flatnonzero(np.diff(np.r_[batch_of, -1])) + 1
    return batch_of, list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True))


def _induce(x, want, seeds, first, k, folder, name, memory) -> np.ndarray:
    """Positions with ``want`` set, in ascending order of their suffixes, induced
    from ``seeds`` (in order; within a symbol they follow the induced ones)."""
    batch_of, ranges = _batches(x, k, memory)
    queue = InductionQueue(batch_of, folder, name, memory)
    out = Tape(folder, name + "-out", memory)
    queue.push(x[first], first)
    seed_at = np.searchsorted(x[seeds], [lo for lo, _ in ranges] + [k])
    for b, (lo, hi) in enumerate(ranges):
        base, own = queue.pop(b), seeds[seed_at[b]:seed_at[b + 1]]
        if hi - lo == 1:
            wave = base
            while len(wave):
                out.add(wave)
                left = _left(wave, want)
                s = x[left]
                queue.push(s[s != lo], left[s != lo])
                wave = left[s == lo]
            left = _left(own, want)
            queue.push(x[left], left)
            continue
        if len(base) + len(own) == 0:
            continue
        pos, induced = _order_batch(x, want, base, own, lo, hi)
        out.add(pos[induced])
        left = _left(pos, want)
        s = x[left]
        queue.push(s[s >= hi], left[s >= hi])
    return out.take()


def _left(pos: np.ndarray, want: np.ndarray) -> np.ndarray:
    left = pos[pos > 0] - 1
    return left[want[left]]


def _order_batch(x, want, base, own, lo, hi):
    """Order of all suffixes with symbols in ``lo..hi`` and which are induced.

    Suffixes that arrived from earlier batches keep their order of arrival;
    those induced inside the batch follow by the order of their right
    neighbours, which is found by doubling along the chains of neighbours.
    """
    pos, parent = [base, own], [np.arange(len(base)), np.arange(len(own))]
    n, front, at = len(base) + len(own), np.concatenate([base, own]), np.arange(len(base) + len(own))
    while True:
        ok = front > 0
        left, up = front[ok] - 1, at[ok]
        ok = want[left] & (x[left] < hi)
        left, up = left[ok], up[ok]
        if not len(left):
            break
        pos.append(left)
        parent.append(up)
        front, at = left, np.arange(n, n + len(left))
        n += len(left)
    fixed = len(base) + len(own)
    pos, parent = np.concatenate(pos), np.concatenate(parent)
    is_seed = np.zeros(n, bool)
    is_seed[len(base):fixed] = True
    high = ((x[pos] - lo).astype(np.int64) * 2 + is_seed) << 40
    place = np.full(n, 1 << 39)
    place[:fixed] = parent[:fixed]
    parent[:fixed] = np.arange(fixed)
    key = high + place
    order = np.argsort(key)                      # equal keys get one rank in any order
    key = key[order]
    first = _firsts(key[1:] != key[:-1])
    rank = np.empty(n, np.int64)                 # place of the first suffix with an equal key
    rank[order] = first
    while True:                                  # chains of right neighbours, twice as long each time
        tied = order[_tied(first)]
        if not len(tied):
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return pos[order], ~is_seed[order]
        key = rank[tied] * n + rank[parent[tied]]
        again = np.argsort(key)
        order, key = tied[again], key[again]
        old = rank[order]
        group, first = _firsts(old[1:] != old[:-1]), _firsts(key[1:] != key[:-1])
        rank[order] = old + first - group
        parent = parent[parent]


def _firsts(changes: np.ndarray) -> np.ndarray:
    """Per element of a sorted list, the place of the first one equal to it."""
    return np.maximum.accumulate(np.where(np.r_[True, changes], np.arange(len(changes) + 1), 0))


def _tied(first: np.ndarray) -> np.ndarray:
    """Which elements share their first place with a neighbour."""
    same = first[1:] == first[:-1]
    return np.r_[False, same] | np.r_[same, False]


def suffix_order(x: np.ndarray, k: int, folder: str, memory: int = MEMORY, depth: int = 0) -> np.ndarray:
    """Starts of the suffixes of ``x`` (symbols 0 to k - 1) in ascending order;
    the end of the string is smaller than any symbol."""
    n = len(x)
    if n < 2:
        return np.arange(n)
    step = np.sign(np.diff(x.astype(np.int64), append=-1))
    nonzero = np.where(step != 0, np.arange(n), n)
    is_s = step[np.minimum.accumulate(nonzero[::-1])[::-1]] > 0          # type of the next change
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    last = np.array([n - 1])

    def induce_all(seeds, tag):
        low = _induce(x, ~is_s, seeds, last, k, folder, f"{depth}-{tag}-l", memory)
        flipped = (k - 1 - x).astype(x.dtype)
        high = _induce(flipped, is_s, low[::-1], last[:0], k, folder, f"{depth}-{tag}-s", memory)
        return low, high[::-1]

    if len(lms) > 1:
        _, high = induce_all(lms[np.argsort(x[lms], kind="stable")], "a")
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_piece = high[is_lms[high]]                            # sorted by LMS substring
        after = np.zeros(n, np.int64)
        after[lms[:-1]], after[lms[-1]] = lms[1:] + 1, n
        h = mix(np.asarray(x).astype(np.uint64) + np.uint64(M2))
        d1, d2 = Digest(h, M1, n + 1), Digest(h, M2, n + 1)
        a, e = by_piece, after[by_piece]
        key = np.stack([d1(a, e), d2(a, e), (e - a).astype(np.uint64) + (a == lms[-1]) * np.uint64(1 << 63)])
        name = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        names = np.zeros(n, np.int64)
        names[by_piece] = name
        if name[-1] + 1 < len(lms):
            lms = lms[suffix_order(names[lms], int(name[-1]) + 1, folder, memory, depth + 1)]
        else:
            lms = by_piece
    low, high = induce_all(lms, "b")
    both = np.concatenate([low, high])
    return both[np.argsort(x[both], kind="stable")]
