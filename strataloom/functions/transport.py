"""Exact optimal transport of small measures, and the comparisons of graphs built on it."""

from __future__ import annotations

import numpy as np


def transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least-cost plan between two measures of equal mass, by shortest augmenting paths over reduced costs."""
    n, m = cost.shape
    plan, a, b = np.zeros((n, m)), p.astype(float).copy(), q.astype(float).copy()
    u, v, tiny = cost.min(axis=1).astype(float), np.zeros(m), 1e-13
    while a.max() > tiny and b.max() > tiny:
        start = int(a.argmax())
        near = np.full(n + m, np.inf)
        near[start], done, back = 0.0, np.zeros(n + m, bool), np.full(n + m, -1)
        while True:
            x = int(np.where(done, np.inf, near).argmin())
            done[x] = True
            if x >= n:
                j = x - n
                if b[j] > tiny:
                    break
                step, at = np.where(plan[:, j] > tiny, near[x], np.inf), slice(0, n)
            else:
                step, at = near[x] + np.maximum(cost[x] - u[x] - v, 0), slice(n, n + m)
            better = ~done[at] & (step < near[at])
            near[at][better], back[at][better] = step[better], x
        reach = near[x]
        u += np.where(done[:n], np.maximum(reach - near[:n], 0), 0)
        v -= np.where(done[n:], np.maximum(reach - near[n:], 0), 0)
        path = [x]
        while path[-1] != start:
            path.append(int(back[path[-1]]))
        path.reverse()
        size = min([a[start], b[x - n]] + [plan[path[i + 1], path[i] - n] for i in range(1, len(path) - 1, 2)])
        for i in range(len(path) - 1):
            if i % 2 == 0:
                plan[path[i], path[i + 1] - n] += size
            else:
                plan[path[i + 1], path[i] - n] -= size
        a[start] -= size
        b[x - n] -= size
    return plan


def gromov_wasserstein(c: np.ndarray, d: np.ndarray, p: np.ndarray, q: np.ndarray, steps: int = 200) -> float:
    """Square root of the squared-loss Gromov-Wasserstein value, by conditional gradient from the product plan.

    The problem isn't convex: the value is an upper bound.
    """
    t = np.outer(p, q)
    fixed = (c**2 @ p)[:, None] + (d**2 @ q)[None, :]
    value = float(((fixed - 2 * c @ t @ d.T) * t).sum())
    for _ in range(steps):
        slope = 2 * (fixed - 2 * c @ t @ d.T)
        move = transport(p, q, slope - slope.min()) - t
        bend, lean = -2 * float((c @ move @ d.T * move).sum()), float((slope * move).sum())
        if lean >= -1e-12:
            break
        far = min(1.0, -lean / (2 * bend)) if bend > 0 else 1.0
        t = t + far * move
        now = float(((fixed - 2 * c @ t @ d.T) * t).sum())
        if value - now <= 1e-10 * max(1.0, abs(value)):
            value = now
            break
        value = now
    return max(value, 0.0) ** 0.5


def co_transport(x: np.ndarray, y: np.ndarray, rows: tuple, cols: tuple, restarts: int = 1, seed: int = 0, steps: int = 100) -> float:
    """Square root of the co-optimal transport value of two relations, the best of some starts.

    Plans of rows and of columns are improved in turn; the first start is the product plan, others are random.
    """
    rng, best = np.random.default_rng(seed), np.inf
    for r in range(restarts):
        f = np.outer(*cols)
        if r:
            f = rng.random(f.shape) + 1e-3
            for _ in range(60):
                f *= (cols[0] / f.sum(axis=1))[:, None]
                f *= (cols[1] / f.sum(axis=0))[None, :]
        value = np.inf
        for _ in range(steps):
            m = (x**2 @ f.sum(axis=1))[:, None] + (y**2 @ f.sum(axis=0))[None, :] - 2 * x @ f @ y.T
            s = transport(*rows, m - m.min())
            m = (x.T**2 @ s.sum(axis=1))[:, None] + (y.T**2 @ s.sum(axis=0))[None, :] - 2 * x.T @ s @ y
            f = transport(*cols, m - m.min())
            now = float((m * f).sum())
            if value - now <= 1e-9:
                value = min(value, now)
                break
            value = now
        best = min(best, value)
    return max(best, 0.0) ** 0.5


def shortest_paths(w: np.ndarray) -> np.ndarray:
    """Path lengths of a matrix of edge lengths (infinite: none); unreachable pairs get twice the largest, or 1."""
    d = w.astype(float).copy()
    np.fill_diagonal(d, 0.0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k][:, None] + d[k][None, :])
    far = ~np.isfinite(d)
    if far.any():
        top = d[~far].max()
        d[far] = 2 * top if top > 0 else 1.0
    return d


def incidence(sets: list[list]) -> np.ndarray:
    """Boolean matrix of sets x nodes; nodes are in sorted order."""
    names = sorted({x for s in sets for x in s})
    at = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(sets), len(names)), bool)
    for i, s in enumerate(sets):
        out[i, [at[x] for x in s]] = True
    return out


def shared_members(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Members that pairs of nodes share: m (patterns x nodes), each pattern standing for n members."""
    x = m.astype(float)
    return x.T @ (x * n[:, None])


def node_distances(m: np.ndarray, n: np.ndarray, how: str = "jaccard") -> np.ndarray:
    """Distances of nodes by their members: jaccard, overlap (against the smaller) or intersection (1 / shared; infinite for none)."""
    both = shared_members(m, n)
    size = np.diag(both)
    if how == "intersection":
        with np.errstate(divide="ignore"):
            out = 1 / both
    elif how in ("jaccard", "overlap"):
        under = np.minimum.outer(size, size) if how == "overlap" else size[:, None] + size[None, :] - both
        out = 1 - both / under
    else:
        raise ValueError(f"unknown node metric {how!r}")
    np.fill_diagonal(out, 0.0)
    return out


def hypernetwork(m: np.ndarray, n: np.ndarray, how: str = "jaccard") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(relation, member measure, node measure): path lengths in the line graph from the nodes of a member to each node.

    Members of one pattern have equal rows, so they stand together with their summed measure; the distance is the same.
    """
    d = shortest_paths(np.where(shared_members(m, n) > 0, node_distances(m, n, how), np.inf))
    degree = m.sum(axis=1) * n.astype(float)
    mass = degree @ m
    relation = np.stack([d[row].min(axis=0) for row in m])
    return relation, degree / degree.sum(), mass / mass.sum()
