"""Persistent cohomology of Vietoris-Rips filtrations in dimensions 0 and 1, over Z/p.

Edges are numbered by length (ties by ends); a triangle is its longest edge and the vertex
across, as one integer, so integers order the triangles and no simplex is ever stored.  A
column is the coboundary of an edge, worked out when it is needed.  Most edges never get
one: an edge with a vertex nearer to both of its ends is paired with a triangle of its own
length, and an edge of the minimum spanning tree has ended a component.

Over Z/2 no columns are reduced: edges come in by length with the living loops that they
count in, and the work ends with the last loop, which mostly needs a small part of the edges.
"""

from __future__ import annotations

import numpy as np

from .kernels import Union

#: Nearest neighbours that are tried as a vertex near to both ends of an edge, before all vertices are.
NEAR = 24


class Dense:
    """Edges of a distance matrix up to a length."""

    def __init__(self, d: np.ndarray, top: float):
        n = len(d)
        i, j = np.nonzero(np.triu(d <= top, 1))
        length = d[i, j]
        order = np.argsort(length, kind="stable")  # the pairs stand by their ends
        self.n, self.i, self.j, self.length = n, i[order], j[order], length[order]
        self.none = len(order)
        self.rank = np.full((n, n), self.none, np.int32 if self.none < 1 << 31 else np.int64)
        self.rank[self.i, self.j] = self.rank[self.j, self.i] = np.arange(len(order))

    @classmethod
    def of(cls, g: Sparse) -> Dense:
        """The same edges, their numbers as a matrix."""
        out = cls.__new__(cls)
        out.n, out.i, out.j, out.length, out.none = g.n, g.i, g.j, g.length, g.none
        out.rank = np.full((g.n, g.n), g.none, np.int32 if g.none < 1 << 31 else np.int64)
        out.rank[g.i, g.j] = out.rank[g.j, g.i] = np.arange(g.none)
        return out

    def beside(self, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vertices that form a triangle with edge e, and the numbers of the edges to its two ends."""
        a, b = self.rank[self.i[e]], self.rank[self.j[e]]
        k = np.flatnonzero((a < self.none) & (b < self.none))
        return k, a[k].astype(np.int64), b[k].astype(np.int64)

    def nearer(self) -> np.ndarray:
        """For each edge the first vertex whose edges to both ends come before it, or -1."""
        out = np.full(self.none, -1)
        step = max(1, 8_000_000 // max(self.n, 1))
        for s in range(0, self.none, step):
            e = slice(s, min(s + step, self.none))
            both = np.maximum(self.rank[self.i[e]], self.rank[self.j[e]]) < np.arange(e.start, e.stop)[:, None]
            at = both.argmax(axis=1)
            out[e] = np.where(both[np.arange(len(at)), at], at, -1)
        return out

    def before(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the other two edges of each triangle in which e is the last edge."""
        a, b = self.rank[self.i[e]], self.rank[self.j[e]]
        k = (np.maximum(a, b) < e).nonzero()[0]
        return a[k], b[k]

    def last_gap(self, e: int) -> int:
        """The last edge from e on that has no vertex nearer to both of its ends, or -1.

        For most edges a near neighbour of an end is such a vertex; those for which it isn't are gone through from the last on.
        """
        bare = []
        near = min(NEAR, self.n - 1)
        for i, own in enumerate(self.rank):
            j = i + 1 + np.flatnonzero((own[i + 1 :] >= e) & (own[i + 1 :] < self.none))
            for k in np.argpartition(own, near - 1)[:near].tolist() if len(j) else ():
                to = own[j]
                j = j[np.maximum(self.rank[k, j], own[k]) >= to]
            bare.append(own[j])
        bare = np.sort(np.concatenate(bare))
        step = max(1, 4_000_000 // max(self.n, 1))
        for hi in range(len(bare), 0, -step):
            f = bare[max(0, hi - step) : hi]
            gap = ~(np.maximum(self.rank[self.i[f]], self.rank[self.j[f]]) < f[:, None]).any(axis=1)
            if gap.any():
                return int(f[gap][-1])
        return -1


class Sparse:
    """The edges of a graph (u, v, length) over vertices 0 to n - 1; no matrix is made."""

    def __init__(self, u: np.ndarray, v: np.ndarray, length: np.ndarray, n: int):
        u, v = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((length, u * n + v))
        u, v, length = u[order], v[order], length[order]
        keep = (u != v) & np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]  # of parallel edges the shortest
        u, v, length = u[keep], v[keep], length[keep]
        order = np.argsort(length, kind="stable")
        self.n, self.i, self.j, self.length, self.none = n, u[order], v[order], length[order], len(order)
        ends, others, number = np.r_[self.i, self.j], np.r_[self.j, self.i], np.r_[np.arange(self.none), np.arange(self.none)]
        order = np.argsort(ends * n + others, kind="stable")
        self.others, self.number = others[order], number[order]
        self.start = np.r_[0, np.cumsum(np.bincount(ends, minlength=n))]

    def beside(self, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = (slice(self.start[x], self.start[x + 1]) for x in (self.i[e], self.j[e]))
        k, a, b = np.intersect1d(self.others[p], self.others[q], assume_unique=True, return_indices=True)
        return k, self.number[p][a], self.number[q][b]

    def before(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        _, a, b = self.beside(e)
        k = np.flatnonzero((a < e) & (b < e))
        return a[k], b[k]

    def last_gap(self, e: int) -> int:
        return next((f for f in range(self.none - 1, e - 1, -1) if not len(self.before(f)[0])), -1)

    def nearer(self) -> np.ndarray:
        out = np.full(self.none, -1)
        for e in range(self.none):
            k, a, b = self.beside(e)
            near = k[np.maximum(a, b) < e]
            if len(near):
                out[e] = near[0]
        return out


def _coboundary(g: Dense | Sparse, e: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangles around edge e, as numbers in order, and their coefficients."""
    k, a, b = g.beside(e)
    i, j = g.i[e], g.j[e]
    longest = np.maximum(np.maximum(a, b), e)
    across = np.where(longest == e, k, np.where(longest == a, j, i))
    key = longest * g.n + across
    order = np.argsort(key)
    sign = np.where((k > i) & (k < j), p - 1, 1)
    return key[order], sign[order]


_ONE = np.ones(1, np.int64)


def _added(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], f: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """x + f * y, modulo p."""
    key = np.concatenate([x[0], y[0]])
    if p == 2:  # what occurs twice goes
        key.sort(kind="stable")  # two sorted runs: a merge
        twice = key[1:] == key[:-1]
        if twice.any():
            keep = np.ones(len(key), bool)
            keep[1:] ^= twice
            keep[:-1] ^= twice
            key = key[keep]
        return key, np.broadcast_to(_ONE, len(key))
    order = np.argsort(key, kind="stable")
    key = key[order]
    c = np.concatenate([x[1], f * y[1]])[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    c = np.add.reduceat(c, at) % p if len(at) else c
    return key[at][c != 0], c[c != 0]


class _Column:
    """A sum of columns as sorted arrays, each at least twice as long as the next, so that a short one is never merged into a long one."""

    def __init__(self, first: tuple[np.ndarray, np.ndarray], p: int):
        self.p, self.parts, self.at = p, [first], [0]

    def add(self, x: tuple[np.ndarray, np.ndarray], f: int) -> None:
        self.parts.append((x[0], x[1] if self.p == 2 else x[1] * f % self.p))
        self.at.append(0)
        while len(self.parts) > 1 and len(self.parts[-2][0]) - self.at[-2] < 2 * (len(self.parts[-1][0]) - self.at[-1]):
            self._merge()

    def _merge(self) -> None:
        (a, b), (i, j) = self.parts[-2:], self.at[-2:]
        self.parts[-2:], self.at[-2:] = [_added((a[0][i:], a[1][i:]), (b[0][j:], b[1][j:]), 1, self.p)], [0]

    def low(self) -> tuple[int, int] | None:
        """The first triangle and its coefficient; None for the zero column."""
        while True:
            heads = [x[0][i] if i < len(x[0]) else -1 for x, i in zip(self.parts, self.at)]
            least = min((h for h in heads if h >= 0), default=-1)
            if least < 0:
                return None
            c = sum(int(x[1][i]) for x, i, h in zip(self.parts, self.at, heads) if h == least) % self.p
            if c:
                return int(least), c
            self.at = [i + (h == least) for i, h in zip(self.at, heads)]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.parts) > 1:
            self._merge()
        x, i = self.parts[0], self.at[0]
        return x[0][i:], x[1][i:]


class _Classes:
    """Which living loops each edge counts in: sets that edges share, by number; number 0 is for those that count in none.

    A loop is the edge it was born with.  Sets are kept with the numbers of those that hold a loop, so one that ends is replaced there alone.
    """

    def __init__(self):
        self.sets: list[set[int]] = [set()]
        self.holders: dict[int, set[int]] = {}  # of each living loop
        self.most = 1024

    def _add(self, s: set[int], e: int, row: np.ndarray) -> None:
        if len(self.sets) >= self.most:
            self._tidy(row)
        row[e] = k = len(self.sets)
        self.sets.append(s)
        for x in s:
            self.holders[x].add(k)

    def _tidy(self, row: np.ndarray) -> None:
        """Sets that came to nothing go."""
        some = np.array([bool(s) for s in self.sets])
        to = np.where(some, np.cumsum(some), 0).astype(row.dtype)
        row[:] = to[row]
        self.sets = [set(), *filter(None, self.sets)]
        to = to.tolist()
        self.holders = {x: {to[k] for k in own} for x, own in self.holders.items()}
        self.most = max(1024, 2 * len(self.sets))

    def born(self, e: int, row: np.ndarray) -> None:
        self.holders[e] = set()
        self._add({e}, e, row)

    def joined(self, both: set[tuple[int, int]], e: int, row: np.ndarray) -> list[int]:
        """Edge e counts in the sum of the sets of any of its triangles' other two edges, which are the same from now on; the loops that end by that."""
        sets, out = self.sets, []
        whole = next((p or q for p, q in both if not (p and q)), None)
        i, j = next(iter(both)) if whole is None else (whole, 0)
        for p, q in both:
            v = sets[i] ^ sets[j] ^ sets[p] ^ sets[q]
            if v:
                out.append(last := max(v))  # the youngest
                self._end(last, v)
        if whole is not None:
            row[e] = whole
        elif first := sets[i] ^ sets[j]:
            self._add(first, e, row)
        return out

    def _end(self, last: int, v: set[int]) -> None:
        """A loop is the sum of the others of v from now on."""
        own = self.holders.pop(last)
        for k in own:
            self.sets[k] ^= v
        for x in v - {last}:
            self.holders[x] ^= own


def _loops(g: Dense | Sparse, tree: np.ndarray) -> list[tuple[int, float, float]]:
    """Loops of some length over Z/2: (1, birth, death).

    Edges come in by length, each with the living loops it counts in.  One without a vertex
    nearer to both ends begins a loop, if it isn't of the tree; else the sums over the other
    two edges of its triangles must agree, and where they don't, a loop ends.  Work stops when
    none lives and none can begin, mostly long before the last edge.
    """
    now, row, out = _Classes(), np.zeros(g.none, np.int32), []
    check, last = 8 * g.n, g.none
    for e in range(g.none):
        if not now.holders and e >= check:
            if last == g.none:
                last = g.last_gap(e)
            if e > last:
                break
        a, b = g.before(e)
        if not len(a):
            if not tree[e]:
                now.born(e, row)
            continue
        if not now.holders:
            continue
        x, y = row[a], row[b]
        some = (x | y).nonzero()[0]
        if not len(some):
            continue
        both = set(zip(x[some].tolist(), y[some].tolist()))
        if len(some) < len(x):  # triangles that add up to nothing: one is enough
            both.add((0, 0))
        for first in now.joined(both, e, row):
            if g.length[e] > g.length[first]:
                out.append((1, float(g.length[first]), float(g.length[e])))
    return out + [(1, float(g.length[e]), np.inf) for e in sorted(now.holders)]


def pairs(g: Dense | Sparse, loops: bool = True, p: int = 2) -> list[tuple[int, float, float]]:
    """(dim, birth, death) of the filtration by length; every bar of dimension 0, loops of some length."""
    parts = Union(g.n)
    tree = np.zeros(g.none, bool)
    out = []
    for e, (i, j) in enumerate(zip(g.i.tolist(), g.j.tolist())):
        if parts.join(i, j):
            tree[e] = True
            out.append((0, 0.0, float(g.length[e])))
            if len(out) == g.n - 1:
                break
    out += [(0, 0.0, np.inf)] * (g.n - len(out))
    if not loops:
        return out
    if p == 2:
        if isinstance(g, Sparse) and g.n**2 <= 16 * g.none:  # most pairs are there
            g = Dense.of(g)
        return out + _loops(g, tree)
    near = g.nearer()
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for e in np.flatnonzero((near < 0) & ~tree)[::-1].tolist():
        column = _Column(_coboundary(g, e, p), p)
        while found := column.low():
            low, c = found
            longest, across = divmod(low, g.n)
            if near[longest] == across:
                other = _coboundary(g, longest, p)
            elif low in held:
                other = held[low]
            else:
                held[low] = column.whole()
                if g.length[longest] > g.length[e]:
                    out.append((1, float(g.length[e]), float(g.length[longest])))
                break
            column.add(other, -c * pow(int(other[1][0]), -1, p) % p)
        else:
            out.append((1, float(g.length[e]), np.inf))
    return out


def greedy_order(row, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points from the first on, each the furthest from those before, and the distance it had to them (the first: infinite); row(i): distances of i to all."""
    order, radius, left = np.zeros(n, int), np.full(n, np.inf), np.full(n, np.inf)
    at = 0
    for k in range(n):
        order[k] = at
        if k:
            radius[at] = left[at]
        left = np.minimum(left, row(at))
        left[at] = -1.0
        at = int(left.argmax())
    return order, radius


def sparse_edges(row, n: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, length) of a sparse filtration whose bars are those of the whole one but for a factor of 1 + eps at most.

    Every point has a ball that grows with the scale until (1 + eps) / eps times its greedy
    radius, then stands, and later is left out; two points are joined when their balls meet
    while both are in.  row(i): distances of i to all points.
    """
    rows = sparse_lengths(row, n, eps)
    us, vs, ds = [], [], []
    for i in range(n):
        d = rows(np.array([i]))[0]
        j = np.flatnonzero(np.isfinite(d))
        j = j[j > i]
        us.append(np.full(len(j), i))
        vs.append(j)
        ds.append(d[j])
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ds)


def sparse_lengths(row, n: int, eps: float):
    """The edges of sparse_edges() as a function of some points: lengths to all points, infinite where there is no edge."""
    _, radius = greedy_order(row, n)
    stop, gone = (1 + eps) / eps * radius, (1 + eps) ** 2 / eps * radius  # of a ball: grows until, is in until

    def rows(points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), n))
        for k, i in enumerate(points.tolist()):
            d = row(i)
            least, most = np.minimum(stop[i], stop), np.maximum(stop[i], stop)
            first = np.minimum(gone[i], gone)
            # Both grow: the balls of radius t meet at 2t = d.  One stands: t = d - its radius.  Both stand: as soon as the second stands, if at all.
            t = np.where(d <= 2 * least, d / 2, d - least)
            keep = (d <= 2 * least) | ((d <= least + most) & (t <= first))
            out[k] = np.where(keep, 2 * t, np.inf)
        return out

    return rows
