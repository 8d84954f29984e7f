"""Bars of dimensions 0 and 1 over Z/2 of clouds too large for a matrix of numbers: edges come in by length, batch by batch, from blocks of rows of distances.

A task holds a block of rows, a batch of edges, the edges up to the last loop's end as lists of
neighbours, and, to know when no loop can begin any more, two bytes a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .cohomology import NEAR, _Classes
from .kernels import Union

#: Edges of a batch, entries of a block of rows, ranges of lengths that are counted at a time.
BATCH, ENTRIES, RANGES = 1 << 20, 1 << 21, 1 << 12


class Rows:
    """Edges among n points, in order of length (ties by their ends), from rows(points): their distances to all, infinite where there is no edge.

    codes: whole numbers in the order of the lengths, where these are at hand.
    """

    def __init__(self, rows: Callable[[np.ndarray], np.ndarray], n: int, threshold: float = np.inf, codes: np.ndarray | None = None):
        self.rows, self.n, self.codes = rows, n, codes
        self.step = max(1, ENTRIES // max(n, 1))
        high, self.least, self.most = np.zeros(n), np.inf, -np.inf
        for s, d in self._blocks():
            high[s : s + len(d)] = d.max(axis=1)
            up = d[np.arange(n) > np.arange(s, s + len(d))[:, None]]
            up = up[np.isfinite(up)]
            self.least, self.most = min(self.least, float(up.min(initial=np.inf))), max(self.most, float(up.max(initial=-np.inf)))
        # Beyond the enclosing radius the complex is a cone: nothing is born or dies there.
        self.top = min(threshold, float(high.min()) if n else threshold, self.most)

    def _blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for s in range(0, self.n, self.step):
            yield s, self.rows(np.arange(s, min(s + self.step, self.n)))

    def _pairs(self, lo: float, hi: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s, d in self._blocks():
            i, j = np.nonzero((d >= lo) & (d <= hi) & (np.arange(self.n) > np.arange(s, s + len(d))[:, None]))
            yield (i + s).astype(np.int32), j.astype(np.int32), d[i, j]

    def batches(self, lo: float | None = None, hi: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, length) of the edges with lengths from lo to hi."""
        lo, hi = self.least if lo is None else lo, self.top if hi is None else hi
        if not lo <= hi:
            return
        if lo == hi:  # in order already
            yield from self._pairs(lo, hi)
            return
        # The first value of each range, so that every length is in one range only.
        first = np.unique(np.r_[lo, np.linspace(lo, hi, RANGES)[1:-1], hi])
        count, small, large = np.zeros(len(first), np.int64), np.full(len(first), np.inf), np.full(len(first), -np.inf)
        for _, _, v in self._pairs(lo, hi):
            at = np.searchsorted(first, v, side="right") - 1
            count += np.bincount(at, minlength=len(first))
            np.minimum.at(small, at, v)
            np.maximum.at(large, at, v)
        k = 0
        while k < len(first):
            e, total = k, 0
            while e < len(first) and (e == k or total + count[e] <= BATCH):
                total += int(count[e])
                e += 1
            a, b = float(small[k:e].min()), float(large[k:e].max())
            if total > BATCH:
                yield from self.batches(a, b)
            elif total:
                i, j, v = (np.concatenate(x) for x in zip(*self._pairs(a, b)))
                order = np.argsort(v, kind="stable")
                yield i[order], j[order], v[order]
            k = e

    def _codes(self) -> np.ndarray:
        """Lengths as whole numbers in their order, in two bytes a pair; different ones may share a number."""
        out, unit = np.empty((self.n, self.n), np.uint16), 65533 / max(self.most - self.least, 1e-300)
        for s, d in self._blocks():
            v = np.where(d > self.most, 65535, np.clip((d - self.least) * unit, 0, 65533)).astype(np.uint16)
            e = s + len(v)
            out[s:e, s:], out[s:, s:e] = v[:, s:], v[:, s:].T
            out[s:e, s:e] = np.triu(v[:, s:e]) + np.triu(v[:, s:e], 1).T
        return out

    def last_gap(self, lo: float) -> float:
        """A length that no edge from lo on exceeds, but for those whose ends have a vertex strictly nearer to both; -inf if there is no other edge.

        For most edges a near neighbour of an end is such a vertex; those for which it isn't are gone through from the longest on.
        """
        code = self._codes() if self.codes is None else self.codes
        near, bare = min(NEAR, self.n - 1), []
        for s, d in self._blocks():
            for i, own, length in zip(range(s, s + len(d)), code[s : s + len(d)], d):
                j = i + 1 + np.flatnonzero((length[i + 1 :] >= lo) & (length[i + 1 :] <= self.top))
                for k in np.argpartition(own, near - 1)[:near].tolist() if len(j) else ():
                    if k != i:
                        j = j[(np.maximum(code[k, j], own[k]) >= own[j]) | (j == k)]
                bare.append((np.full(len(j), i, np.int32), j.astype(np.int32), length[j]))
        i, j, v = (np.concatenate(x) for x in zip(*bare))
        order = np.argsort(-v, kind="stable")
        for k in range(0, len(order), self.step):
            some = order[k : k + self.step]
            own = code[i[some], j[some]]
            gap = ~(np.maximum(code[i[some]], code[j[some]]) < own[:, None]).any(axis=1)
            if gap.any():
                return float(v[some][gap][0])
        return -np.inf


class _Lists:
    """Neighbours of each point so far, and the numbers of the edges to them."""

    def __init__(self, n: int):
        self.others = [np.empty(8, np.int32) for _ in range(n)]
        self.numbers = [np.empty(8, np.int32) for _ in range(n)]
        self.size = [0] * n
        self.at = np.full(n, -1, np.int32)

    def before(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the other two edges of each triangle over (i, j)."""
        if self.size[i] > self.size[j]:
            i, j = j, i
        own, other = self.others[i][: self.size[i]], self.others[j][: self.size[j]]
        self.at[own] = self.numbers[i][: self.size[i]]
        a = self.at[other]
        self.at[own] = -1
        k = (a >= 0).nonzero()[0]
        return a[k], self.numbers[j][k]

    def add(self, i: int, j: int, e: int) -> None:
        for a, b in ((i, j), (j, i)):
            s = self.size[a]
            if s == len(self.others[a]):
                self.others[a], self.numbers[a] = (np.r_[x, np.empty(s // 2, np.int32)] for x in (self.others[a], self.numbers[a]))
            self.others[a][s], self.numbers[a][s] = b, e
            self.size[a] = s + 1


def pairs(g: Rows) -> list[tuple[int, float, float]]:
    """cohomology.pairs() over Z/2; work ends with the last loop, mostly long before the last edge."""
    out, left = [], g.n
    for dim, birth, death in _ended(g):
        out.append((dim, birth, death))
        left -= dim == 0
    return out + [(0, 0.0, np.inf)] * left


def _ended(g: Rows) -> Iterator[tuple[int, float, float]]:
    """The bars of dimension 0 that end, and all loops of some length."""
    parts, left = Union(g.n), g.n - 1
    now, lists, row, born, e, last = _Classes(), _Lists(g.n), np.zeros(1 << 16, np.int32), {}, 0, None
    for us, vs, lengths in g.batches():
        for i, j, length in zip(us.tolist(), vs.tolist(), lengths.tolist()):
            if not now.holders and left <= 0 and e >= 8 * g.n:
                if last is None:
                    last = g.last_gap(length)
                if length > last:
                    return
            if e == len(row):
                row = np.r_[row, np.zeros(len(row) // 2, np.int32)]
            tree = left > 0 and parts.join(i, j)
            if tree:
                left -= 1
                yield 0, 0.0, length
            a, b = lists.before(i, j)
            if not len(a):
                if not tree:
                    now.born(e, row)
                    born[e] = length
            elif now.holders:
                x, y = row[a], row[b]
                some = (x | y).nonzero()[0]
                if len(some):
                    both = set(zip(x[some].tolist(), y[some].tolist()))
                    if len(some) < len(x):
                        both.add((0, 0))
                    for first in now.joined(both, e, row):
                        since = born.pop(first)
                        if length > since:
                            yield 1, since, length
            lists.add(i, j, e)
            e += 1
    for k in sorted(now.holders):
        yield 1, born[k], np.inf
