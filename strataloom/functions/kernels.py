"""Numeric kernels: plain NumPy functions of one group's arrays, wrapped by grouped Arrow functions elsewhere."""

from __future__ import annotations

from itertools import combinations

import numpy as np

EULER = 0.5772156649015329


def distance_block(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of the rows of a to the rows of b."""
    if metric == "euclidean":
        out = np.empty((len(a), len(b)))
        for i, x in enumerate(a):  # differences, not the expanded square: exact zeros and no cancellation
            out[i] = np.sqrt(((b - x) ** 2).sum(axis=1))
        return out
    if metric == "cityblock":
        return np.stack([np.abs(b - x).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric == "mean_difference":
        return np.stack([np.abs(b - x).mean(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric == "hamming":
        return np.stack([(b != x).mean(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric in ("cosine", "correlation", "abs_correlation"):
        if metric != "cosine":
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            c = (a @ b.T) / np.outer(na, nb)
        return 1 - np.abs(c) if metric == "abs_correlation" else 1 - c
    raise ValueError(f"unknown metric {metric!r}")


def row_blocks(x: np.ndarray, metric: str = "euclidean", entries: int = 4_000_000):
    """(start, distances of the next rows of x to all rows), in blocks of bounded size."""
    step = max(1, entries // max(len(x), 1))
    for s in range(0, len(x), step):
        yield s, distance_block(x[s : s + step], x, metric)


def kth_distances(x: np.ndarray, k: int, metric: str = "euclidean") -> np.ndarray:
    """Place k of each row's sorted distances to all rows; the row itself has place 0."""
    if metric == "euclidean" and k and np.isfinite(x).all():
        from .screen import Nearest

        ids, out = np.arange(len(x)), np.zeros(len(x))
        for s in range(0, len(x), 1 << 14):
            near = Nearest(ids[s : s + (1 << 14)], x[s : s + (1 << 14)], k, metric)
            near.see(ids, x)
            i, _, rank, d = near.rows()
            out[i[rank == k]] = d[rank == k]
        return out
    return np.concatenate([np.partition(d, k, axis=1)[:, k].copy() for _, d in row_blocks(x, metric)])


def point_tree(x: np.ndarray, metric: str = "euclidean", threshold: float = np.inf) -> list[tuple[float, int, int]]:
    """The minimum spanning forest of points by edges up to a threshold, from rows of distances: memory grows with the points."""

    def row(i):
        d = distance_block(x[i : i + 1], x, metric)[0]
        return np.where(d <= threshold, d, np.inf)

    return _prim(len(x), row)


def minimum_spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (weight, i, j) of a minimum spanning forest by Prim; infinite weights aren't edges."""
    return _prim(len(d), d.__getitem__)


def _prim(n: int, row, bounded: bool = False) -> list[tuple[float, int, int]]:
    """The forest from a function that gives the weights of a row, so the matrix need not be held.

    bounded: the function also gets the least weights so far, and may leave out (as infinite) those that are no less; nodes in the tree have -inf.
    """
    best, at, left, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool), []
    for _ in range(n):
        i = int(np.flatnonzero(left)[np.argmin(best[left])])
        left[i] = False
        if np.isfinite(best[i]):
            out.append((float(best[i]), int(at[i]), i))
        d = row(i, np.where(left, best, -np.inf)) if bounded else row(i)
        near = left & (d < best)
        best[near], at[near] = d[near], i
    return sorted(out)


def bipartite_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """(length, row, column) of the minimum spanning forest of the graph that joins every row with every column; infinite entries are no edges."""
    n, m = d.shape
    turned = np.ascontiguousarray(d.T)
    best, via, still = np.full(n + m, np.inf), np.zeros(n + m, int), np.ones(n + m, bool)
    out, at = [], 0
    for _ in range(n + m):
        still[at] = False
        best[at] = np.inf
        side, new = (slice(n, None), d[at]) if at < n else (slice(0, n), turned[at - n])
        near = np.flatnonzero((new < best[side]) & still[side])
        best[side][near] = new[near]
        via[side][near] = at
        at = int(best.argmin())
        if best[at] < np.inf:
            out.append((float(best[at]), *((via[at], at - n) if at >= n else (at, via[at] - n))))
        elif still.any():
            at = int(still.argmax())
    return out


class Union:
    """Disjoint sets; a set's name is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> np.ndarray:
        return np.unique([self.find(x) for x in range(len(self.up))], return_inverse=True)[1]


def reduce_complex(simplices: list[tuple[tuple[int, ...], float]], coeff: int = 2) -> list[tuple[int, float, float, tuple, tuple | None]]:
    """Persistence pairs (dim, birth, death, birth simplex, death simplex) of a filtered complex over Z/coeff.

    simplices: (sorted vertices, value) with values that no face exceeds; essential classes die at infinity.
    """
    order = sorted(range(len(simplices)), key=lambda i: (simplices[i][1], len(simplices[i][0]), simplices[i][0]))
    cells = [simplices[i] for i in order]
    index = {s: i for i, (s, _) in enumerate(cells)}
    low: dict[int, dict[int, int]] = {}
    paired: dict[int, int] = {}
    for dim in range(max((len(s) for s, _ in cells), default=1) - 1, 0, -1):
        for j, (s, _) in enumerate(cells):
            if len(s) != dim + 1 or j in paired:  # clearing: a birth of the dimension above has no boundary left
                continue
            col = {index[s[:x] + s[x + 1 :]]: (1 if x % 2 == 0 else coeff - 1) for x in range(len(s))}
            while col:
                p = max(col)
                if p not in low:
                    break
                other = low[p]
                f = col[p] * pow(other[p], -1, coeff) % coeff
                for k, v in other.items():
                    w = (col.get(k, 0) - f * v) % coeff
                    if w:
                        col[k] = w
                    else:
                        col.pop(k, None)
            if col:
                low[max(col)] = col
                paired[max(col)] = j
    dead = set(paired.values())
    out = []
    for i, (s, f) in enumerate(cells):
        if i in paired:
            out.append((len(s) - 1, f, cells[paired[i]][1], s, cells[paired[i]][0]))
        elif i not in dead:
            out.append((len(s) - 1, f, np.inf, s, None))
    return out


def rips(d: np.ndarray, max_dim: int = 1, threshold: float = np.inf, coeff: int = 2) -> list[tuple[int, float, float]]:
    """Vietoris-Rips diagram (dim, birth, death) of a distance matrix; bars of no length are left out but in dimension 0."""
    n = len(d)
    if max_dim == 0:
        tree = [w for w, _, _ in minimum_spanning_tree(np.where(d <= threshold, d, np.inf))]
        return [(0, 0.0, w) for w in tree] + [(0, 0.0, np.inf)] * (n - len(tree))
    # Beyond the enclosing radius the complex is a cone: nothing is born or dies there.
    top = min(threshold, float(d.max(axis=1).min())) if n else threshold
    if max_dim == 1:
        from .cohomology import Dense, pairs

        return pairs(Dense(d, top), True, coeff)
    near = (d <= top) & ~np.eye(n, dtype=bool)
    cells: list[tuple[tuple[int, ...], float]] = [((i,), 0.0) for i in range(n)]
    level = [((i, j), float(d[i, j])) for i in range(n) for j in np.flatnonzero(near[i]).tolist() if i < j]
    for dim in range(1, max_dim + 2):
        cells += level
        if dim > max_dim:
            break
        new = []
        for s, f in level:
            for k in np.flatnonzero(np.logical_and.reduce([near[v] for v in s])).tolist():
                if k > s[-1]:
                    new.append(((*s, k), max(f, float(d[list(s), k].max()))))
        level = new
    return [(k, b, e) for k, b, e, _, _ in reduce_complex(cells, coeff) if k <= max_dim and (k == 0 or e > b)]


def betti0(d: np.ndarray, eps: float) -> int:
    u = Union(len(d))
    return len(d) - sum(u.join(i, j) for i, j in zip(*np.nonzero(np.triu(d <= eps, 1))))


def dbscan(d: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels by density; -1 is noise.  A point counts among its own neighbours; clusters are numbered by first core point."""
    near = d <= eps
    core = near.sum(axis=1) >= min_samples
    labels, k = np.full(len(d), -1), 0
    for s in np.flatnonzero(core):
        if labels[s] >= 0:
            continue
        labels[s], todo = k, [s]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if labels[j] < 0:
                    labels[j] = k
                    if core[j]:
                        todo.append(j)
        k += 1
    return labels


def dbscan_points(x: np.ndarray, eps: float, min_samples: int, metric: str = "euclidean") -> np.ndarray:
    """dbscan of points: the same labels from blocks of distances, in memory that grows with the points and not their pairs."""
    from .screen import within

    count = np.zeros(len(x), np.int64)
    for at, _, near in within(x, x, eps, metric):
        count[at : at + len(near)] += near.sum(axis=1)
    core = count >= min_samples
    labels, k, step = np.full(len(x), -1), 0, 1 << 14
    for s in np.flatnonzero(core):
        if labels[s] >= 0:
            continue
        labels[s], todo = k, np.array([s])
        while len(todo):
            part, todo, free = todo[:step], todo[step:], np.flatnonzero(labels < 0)
            met = np.zeros(len(free), bool)
            for _, at, near in within(x[part], x[free], eps, metric):
                met[at : at + near.shape[1]] |= near.any(axis=0)
            hit = free[met]
            labels[hit] = k
            todo = np.r_[todo, hit[core[hit]]]
        k += 1
    return labels


def linkage_labels(d: np.ndarray, cut: float | None = None, method: str = "single", relative_gap: float | None = None) -> np.ndarray:
    """Agglomerative labels, cut at a height or (relative_gap) in the middle of the first merge gap over that share of the range."""
    n = len(d)
    if n < 2:
        return np.zeros(n, int)
    if method == "single":
        merges = minimum_spanning_tree(d)
    else:
        x, size, alive, merges = d.astype(float) ** (2 if method == "ward" else 1), np.ones(n), list(range(n)), []
        np.fill_diagonal(x, np.inf)
        while len(alive) > 1:
            sub = x[np.ix_(alive, alive)]
            p = int(np.argmin(sub))
            i, j = alive[p // len(alive)], alive[p % len(alive)]
            h = x[i, j]
            merges.append((float(np.sqrt(h)) if method == "ward" else float(h), i, j))
            for k in alive:
                if k not in (i, j):
                    if method == "complete":
                        v = max(x[i, k], x[j, k])
                    elif method == "average":
                        v = (size[i] * x[i, k] + size[j] * x[j, k]) / (size[i] + size[j])
                    else:
                        v = ((size[i] + size[k]) * x[i, k] + (size[j] + size[k]) * x[j, k] - size[k] * h) / (size[i] + size[j] + size[k])
                    x[i, k] = x[k, i] = v
            size[i] += size[j]
            alive.remove(j)
        merges.sort(key=lambda m: m[0])
    if relative_gap is not None:
        h = [m[0] for m in merges]
        span = h[-1] - h[0]
        gap = next((i for i in range(len(h) - 1) if h[i + 1] - h[i] > relative_gap * span), None) if span > 0 else None
        cut = np.inf if gap is None else (h[gap] + h[gap + 1]) / 2
    u = Union(n)
    for w, i, j in merges:
        if w <= cut:
            u.join(i, j)
    return u.labels()


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost perfect matching, by shortest augmenting paths."""
    n = len(cost)
    u, v, row_of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.flatnonzero(free)[np.argmin(least[1:][free])]) + 1
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def _matching_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs between the points of two diagrams and their diagonals, in the maximum norm."""
    n, m = len(a), len(b)
    c = np.zeros((n + m, n + m))
    if n and m:
        c[:n, :m] = np.abs(a[:, None, :] - b[None, :, :]).max(axis=2)
    c[:n, m:] = ((a[:, 1] - a[:, 0]) / 2)[:, None] if n else 0
    c[n:, :m] = ((b[:, 1] - b[:, 0]) / 2)[None, :] if m else 0
    return c


def wasserstein(a: np.ndarray, b: np.ndarray, order: float = 1.0) -> float:
    """Distance of two finite diagrams, (birth, death) rows."""
    if not len(a) and not len(b):
        return 0.0
    c = _matching_costs(a, b) ** order
    return float(c[np.arange(len(c)), assignment(c)].sum() ** (1 / order))


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Least threshold at which a perfect matching exists, by bisection over the costs."""
    if not len(a) and not len(b):
        return 0.0
    c = _matching_costs(a, b)
    values = np.unique(c)
    lo, hi = 0, len(values) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        over = (c > values[mid]).astype(float)
        if over[np.arange(len(c)), assignment(over)].sum() == 0:
            hi = mid
        else:
            lo = mid + 1
    return float(values[lo])


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of distinct finite points; 0 for fewer than three or collinear ones."""
    p = sorted(set(map(tuple, points[np.isfinite(points).all(axis=1)].tolist())))
    if len(p) < 3:
        return 0.0

    def half(q):
        h: list = []
        for x in q:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (x[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (x[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(x)
        return h[:-1]

    x, y = np.array(half(p) + half(p[::-1])).T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def two_nn_dimension(d: np.ndarray) -> float:
    """exp(-gamma - mean ln ln(r2/r1)) over ratios above 1; 0 if there is none."""
    r = np.partition(d + np.diag(np.full(len(d), np.inf)), 1, axis=1)[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        mu = np.where(r[:, 0] > 0, r[:, 1] / r[:, 0], 1.0)
    mu = mu[mu > 1]
    return float(np.exp(-EULER - np.log(np.log(mu)).mean())) if len(mu) else 0.0


def knn_log_statistic(d: np.ndarray, k: int, j: int) -> float:
    """Mean of -ln ln(R_k / R_j) over points where it is defined."""
    s = np.sort(d, axis=1)
    rk, rj = s[:, k], s[:, j]
    ok = (rj > 0) & (rk > rj)
    return float(-np.log(np.log(rk[ok] / rj[ok])).mean()) if ok.any() else float("nan")


def magnitude(d: np.ndarray, t: float) -> float:
    z = np.exp(-t * d)
    return float(np.linalg.lstsq(z, np.ones(len(d)), rcond=None)[0].sum())


def magnitude_slope(d: np.ndarray, scales: int = 30) -> float:
    """Largest slope of log magnitude over log scale; NaN if fewer than five scales can be used."""
    med = np.median(d[~np.eye(len(d), dtype=bool) & (d > 0)])
    t = magnitude_scales(med, scales)
    return slope_of_magnitudes(len(d), t, np.array([magnitude(d, x) for x in t]))


def magnitude_scales(median: float, scales: int) -> np.ndarray:
    return np.geomspace(0.01 / median, 100 / median, scales)


def slope_of_magnitudes(n: int, t: np.ndarray, m: np.ndarray) -> float:
    """magnitude_slope() from the magnitudes m of n points at scales t."""
    ok = (m > 0) & (m <= 1.05 * n)
    return float(np.gradient(np.log(m[ok]), np.log(t[ok])).max()) if ok.sum() >= 5 else float("nan")


def hop_distances(near: np.ndarray) -> np.ndarray:
    """Hop counts in an undirected graph; unreachable pairs get twice the largest finite count."""
    n = len(near)
    out = np.full((n, n), np.inf)
    for s in range(n):
        seen = np.zeros(n, bool)
        front, hops = np.zeros(n, bool), 0
        front[s] = True
        while front.any():
            out[s, front] = hops
            seen |= front
            front = near[front].any(axis=0) & ~seen
            hops += 1
    top = out[np.isfinite(out)].max()
    out[np.isinf(out)] = 2 * top
    return out


def hop_counts(u: np.ndarray, v: np.ndarray, n: int, sources: int = 512) -> np.ndarray:
    """How many ordered pairs of the n nodes of an undirected graph are 0, 1, 2 ... hops apart; every node has an edge.

    Searches go from some sources at a time, a bit each, so memory grows with the edges and not the pairs.
    """
    a, b = np.r_[u, v], np.r_[v, u]
    order = np.argsort(a, kind="stable")
    b, starts = b[order], np.searchsorted(a[order], np.arange(n))
    counts = [n]
    for s in range(0, n, sources):
        m = min(sources, n - s)
        new = np.zeros((n, -(-m // 64)), np.uint64)
        new[s + np.arange(m), np.arange(m) // 64] = np.uint64(1) << (np.arange(m) % 64).astype(np.uint64)
        seen, hops = new.copy(), 0
        while True:
            new = np.bitwise_or.reduceat(new[b], starts, axis=0) & ~seen
            c, hops = int(np.bitwise_count(new).sum()), hops + 1
            if not c:
                break
            seen |= new
            counts += [0] * (hops + 1 - len(counts))
            counts[hops] += c
    return np.array(counts, np.int64)


def laplacian_vectors(w: np.ndarray, k: int) -> np.ndarray:
    """Eigenvectors 2 to k+1 of the normalised Laplacian; the largest component of each is positive."""
    deg = w.sum(axis=1)
    s = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
    _, v = np.linalg.eigh(np.eye(len(w)) - s[:, None] * w * s[None, :])
    v = v[:, 1 : k + 1]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def geodesic_distances(d: np.ndarray, k: int) -> np.ndarray:
    """Hop counts in the graph that joins each point with its k nearest others, in either direction."""
    order = np.argsort(d + np.diag(np.full(len(d), np.inf)), axis=1, kind="stable")[:, :k]
    near = np.zeros(d.shape, bool)
    near[np.arange(len(d))[:, None], order] = True
    return hop_distances(near | near.T)


def hop_matrix(x: np.ndarray, k: int) -> np.ndarray:
    """geodesic_distances() of points in as few bytes a pair as hold the counts, from rows of distances; sources go together, a bit each."""
    n = len(x)
    near = np.empty((n, min(k, n - 1)), np.int64)
    for s, d in row_blocks(x, entries=2_000_000):
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near[s : s + len(d)] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
    ends = np.unique(np.r_[np.repeat(np.arange(n), near.shape[1]) * n + near.reshape(-1), near.reshape(-1) * n + np.repeat(np.arange(n), near.shape[1])])
    other, start = ends % n, np.searchsorted(ends // n, np.arange(n))
    out, top = np.zeros((n, n), np.uint8), 0
    for s in range(0, n, 512):
        e = min(s + 512, n)
        seen = np.zeros((n, 64), np.uint8)
        at = np.arange(e - s)
        seen[at + s, at // 8] = 1 << (at % 8).astype(np.uint8)
        seen, hops = seen.view(np.uint64), 0
        front = seen.copy()
        while front.any():
            if 2 * hops > np.iinfo(out.dtype).max:
                out = out.astype(np.uint16 if out.itemsize == 1 else np.uint32)
            met = np.unpackbits(front.view(np.uint8), axis=1, count=e - s, bitorder="little").T.astype(bool)
            out[s:e][met] = hops
            top = max(top, hops)
            front = np.bitwise_or.reduceat(front[other], start, axis=0) & ~seen
            seen |= front
            hops += 1
    own = np.arange(n)
    for s in range(0, n, 512):  # only the diagonal stands at 0 among the reached
        part = out[s : s + 512]
        part[(part == 0) & (own[s : s + 512, None] != own)] = 2 * top
    return out


def hdbscan(d: np.ndarray, least: int) -> np.ndarray:
    """Labels of the most stable clusters over all densities; -1 is noise.  Clusters are numbered by first member.

    Mutual reachability with the distance to the least-th point (itself counted), its merge tree
    condensed to clusters of at least that many, chosen by excess of mass; the whole is no cluster.
    """
    core = np.sort(d, axis=1)[:, min(least, len(d)) - 1]
    return _stable(minimum_spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None, :]))), len(d), least)


def hdbscan_points(x: np.ndarray, least: int, metric: str = "euclidean") -> np.ndarray:
    """hdbscan of points: the same labels from rows of distances, in memory that grows with the points and not their pairs."""
    core = kth_distances(x, min(least, len(x)) - 1, metric)
    if metric != "euclidean" or not np.isfinite(x).all():
        reach = lambda i: np.maximum(distance_block(x[i : i + 1], x, metric)[0], np.maximum(core[i], core))
        return _stable(_prim(len(x), reach), len(x), least)
    z = (x - x.mean(axis=0)).astype(np.float32)
    size = (z * z).sum(axis=1)
    slack = np.float32((x.shape[1] + 8) * 4.8e-7) * size + np.float32(1e-12 * np.abs(x).max(initial=0) ** 2)

    def row(i, best):
        """Reachability from i where it may be less than best; a product in single precision bounds the distance from below."""
        low = size - 2 * (z @ z[i]) + size[i] - slack - slack[i]
        some = np.flatnonzero((core < best) & (core[i] < best) & ((low <= 0) | (low < best * best * 1.000001)))
        out = np.full(len(x), np.inf)
        out[some] = np.maximum(distance_block(x[i : i + 1], x[some])[0], np.maximum(core[i], core[some]))
        return out

    return _stable(_prim(len(x), row, True), len(x), least)


def _stable(tree: list[tuple[float, int, int]], n: int, least: int) -> np.ndarray:
    """hdbscan's labels from the spanning tree of mutual reachability."""
    top, below, height, size, first = list(range(n)), {}, {}, dict.fromkeys(range(n), 1), {i: i for i in range(n)}
    u = Union(n)
    for w, i, j in tree:
        a, b = u.find(i), u.find(j)
        node = n + len(below)
        below[node], height[node] = (top[a], top[b]), w
        size[node], first[node] = size[top[a]] + size[top[b]], min(first[top[a]], first[top[b]])
        u.join(i, j)
        top[u.find(i)] = node
    born, mass, kids = {0: 0.0}, {0: 0.0}, {0: []}
    owns, todo = {0: top[0]}, [(top[0], 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        rate = 1 / height[node] if height[node] > 0 else 1e300
        sides = [x for x in below[node] if size[x] >= least]
        if len(sides) == 2:
            for x in sides:
                k = len(born)
                born[k], mass[k], kids[k], owns[k] = rate, 0.0, [], x
                mass[c] += (rate - born[c]) * size[x]
                kids[c].append(k)
                todo.append((x, k))
        else:
            gone = size[node] - (size[sides[0]] if sides else 0)
            mass[c] += (rate - born[c]) * gone
            todo += [(x, c) for x in sides]
    chosen: dict[int, list[int]] = {}
    for c in sorted(born, reverse=True):
        inner = sum(mass[k] for k in kids[c])
        if c == 0 or inner > mass[c]:
            mass[c], chosen[c] = inner, [x for k in kids[c] for x in chosen[k]]
        else:
            chosen[c] = [c]
    labels = np.full(n, -1)
    for i, c in enumerate(sorted(chosen[0], key=lambda c: first[owns[c]])):
        todo = [owns[c]]
        while todo:  # the chosen clusters are disjoint, so each point is reached once
            node = todo.pop()
            if node < n:
                labels[node] = i
            else:
                todo += below[node]
    return labels


def elbow(d: np.ndarray, least: int) -> float:
    """Distance at the knee of the sorted k-nearest-neighbour distances: furthest under the chord."""
    return _knee(np.sort(d, axis=1)[:, min(least, len(d) - 1)])


def elbow_points(x: np.ndarray, least: int, metric: str = "euclidean") -> float:
    """elbow of points, from blocks of distances."""
    return _knee(kth_distances(x, min(least, len(x) - 1), metric))


def _knee(near: np.ndarray) -> float:
    x = np.sort(near)
    if x[-1] <= x[0]:
        return float(x[-1])
    return float(x[np.argmax(np.linspace(0, 1, len(x)) - (x - x[0]) / (x[-1] - x[0]))])


def subsets(n: int, k: int):
    return combinations(range(n), k)
