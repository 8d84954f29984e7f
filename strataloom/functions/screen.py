"""Exact distances of the pairs that matter: products of matrices, with the bound of their error, leave out the others."""

from __future__ import annotations

import numpy as np

from .kernels import distance_block

#: Rows of a block and of the others that are compared at a time, and pairs whose differences are made at a time.
ROWS, OTHERS, PAIRS = 512, 4096, 1 << 15


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row i of a to row i of b; equal rows give equal ones."""
    out = np.empty(len(a))
    for s in range(0, len(a), PAIRS):
        x, y = a[s : s + PAIRS], b[s : s + PAIRS]
        if metric == "euclidean":
            out[s : s + PAIRS] = np.sqrt(((y - x) ** 2).sum(axis=1))
        elif metric in ("cityblock", "mean_difference"):
            d = np.abs(y - x)
            out[s : s + PAIRS] = d.sum(axis=1) if metric == "cityblock" else d.mean(axis=1)
        else:
            if metric == "correlation":
                x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[s : s + PAIRS] = 1 - (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return out


def lawful(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """Pairs of a row of a and one of b whose euclidean distances, worked out either way, are surely finite, not negative and within a tolerance of each other.

    A distance of d or more, whose square is known but for s, is known but for s / d.  Near and equal rows, and what isn't finite, are left to exact().
    """
    with np.errstate(all="ignore"):
        p, q = (a * a).sum(axis=1), (b * b).sum(axis=1)
        g = np.column_stack([-2 * a, p, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), q]).T
        slack = 2.3e-16 * 8 * (a.shape[1] + 16) * (p[np.isfinite(p)].max(initial=0) + q[np.isfinite(q)].max(initial=0)) + 1e-300
        least = 2 * slack + (2 * slack / tolerance) ** 2 if tolerance > 0 else np.inf
        if g.min(initial=np.inf) >= least and g.max(initial=0) <= 1e300:
            return np.broadcast_to(True, g.shape)
        return (g >= least) & (g <= 1e300)


class Screen:
    """Which pairs of fixed rows and others can be within a bound of each fixed row; every pair that is within it is among them."""

    def __init__(self, x: np.ndarray, metric: str):
        self.metric, self.x = metric, x
        fine = x[np.isfinite(x).all(axis=1)]
        self.middle = fine.mean(axis=0) if len(fine) and metric in ("euclidean", "cityblock", "mean_difference") else np.zeros(x.shape[1])
        self.top = np.abs(fine).max(initial=0)
        self.z = self._ready(x)
        self.size = self._size(self.z)

    def _ready(self, x):
        if self.metric in ("cosine", "correlation"):
            x = x - x.mean(axis=1, keepdims=True) if self.metric == "correlation" else x
            with np.errstate(invalid="ignore", divide="ignore"):
                return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        if self.metric == "euclidean":
            return x - self.middle
        return (x - self.middle).astype(np.float32)

    def _size(self, z):
        return np.abs(z).sum(axis=1, dtype=float) if self.metric in ("cityblock", "mean_difference") else (z * z).sum(axis=1)

    def __call__(self, lo: int, hi: int, y: np.ndarray, bound: np.ndarray, k: int | None = None):
        """(row, column) of pairs of rows lo to hi with rows of y that may be within the rows' bounds; where these are infinite and k is given, that may be of the k least."""
        z, size = self._ready(y), None
        if self.metric not in ("euclidean", "cosine", "correlation", "cityblock", "mean_difference"):
            g = distance_block(self.x[lo:hi], y, self.metric)
            most, slack = bound[lo:hi].copy(), 0.0
        elif self.metric in ("cityblock", "mean_difference"):
            size = self._size(z)
            zt, g = np.ascontiguousarray(z.T), np.empty((hi - lo, len(y)), np.float32)
            for i in range(lo, hi):
                np.abs(zt - self.z[i][:, None]).sum(axis=0, out=g[i - lo])
            if self.metric == "mean_difference":
                g /= z.shape[1]
            slack = (z.shape[1] + 8) * 2.4e-7 * (self.size[lo:hi] + size[np.isfinite(size)].max(initial=0) + self.top) + 1e-30
            most = bound[lo:hi] + slack
        else:
            eps = 2.3e-16 * 8 * (z.shape[1] + 8)
            with np.errstate(invalid="ignore", over="ignore"):
                g = self.z[lo:hi] @ z.T
            if self.metric == "euclidean":
                size = self._size(z)
                top = max(self.top, np.abs(y[np.isfinite(y)]).max(initial=0))
                slack = eps * (self.size[lo:hi] + size[np.isfinite(size)].max(initial=0)) + 1e-300
                g *= -2
                g += size
                off = 1e-15 * top * np.sqrt(z.shape[1])
                most = (bound[lo:hi] + off) ** 2 + slack - self.size[lo:hi]
            else:
                np.negative(g, out=g)
                slack = eps
                most = bound[lo:hi] - 1 + slack
        wide = ~np.isfinite(bound[lo:hi])
        if k is not None and wide.any() and g.shape[1] > k:
            least = np.partition(g[wide], k, axis=1)[:, k]  # the row itself may be one
            more = 2 * slack if np.ndim(slack) == 0 else 2 * slack[wide]
            if self.metric == "euclidean":
                more = more + 4 * off * np.sqrt(np.maximum(least + self.size[lo:hi][wide], 0)) + off * off
            most[wide] = np.where(np.isnan(least), np.inf, least + more)
        return np.nonzero(g <= most[:, None])


class Nearest:
    """The k nearest others of the rows of a block among all that pass by, ties by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.ids, self.x, self.k, self.metric = ids, x, k, metric
        self.screen, self.exact = Screen(x, metric), metric in ("euclidean", "cosine", "correlation", "cityblock", "mean_difference")
        self.bound = np.full(len(ids), np.inf)
        self.best, self.new, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        for s in range(0, len(ids), OTHERS):
            j, y = ids[s : s + OTHERS], x[s : s + OTHERS]
            for r in range(0, len(self.ids), ROWS):
                p, q = self.screen(r, min(r + ROWS, len(self.ids)), y, self.bound, self.k)
                p = p + r
                other = self.ids[p] != j[q]
                p, q = p[other], q[other]
                if self.exact:
                    d = exact(self.x[p], y[q], self.metric) if len(p) <= PAIRS else np.concatenate([exact(self.x[p[c : c + PAIRS]], y[q[c : c + PAIRS]], self.metric) for c in range(0, len(p), PAIRS)])
                else:
                    d = np.concatenate([distance_block(self.x[i : i + 1], y[q[a:b]], self.metric)[0] for i, a, b in self._runs(p)]) if len(p) else np.zeros(0)
                ok = np.isfinite(d) & (d <= self.bound[p])
                if ok.any():
                    self.new.append((p[ok], j[q[ok]], d[ok]))
                    self.waiting += int(ok.sum())
                if self.waiting > max(1 << 20, len(self.ids) * self.k):
                    self._merge()
            self._merge()

    @staticmethod
    def _runs(p):
        at = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)]
        return zip(p[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist())

    def _merge(self) -> None:
        if not self.new:
            return
        touched = np.zeros(len(self.ids), bool)
        for p, _, _ in self.new:
            touched[p] = True
        old = touched[self.best[0]]
        p, j, d = (np.concatenate([self.best[c][old], *[n[c] for n in self.new]]) for c in range(3))
        o = np.lexsort((j, d, p))
        p, j, d = p[o], j[o], d[o]
        place = np.arange(len(p)) - np.searchsorted(p, p)
        last = place == self.k - 1
        self.bound[p[last]] = d[last]
        keep = place < self.k
        self.best = tuple(np.concatenate([self.best[c][~old], v[keep]]) for c, v in enumerate((p, j, d)))
        self.new, self.waiting = [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, rank, d)."""
        self._merge()
        p, j, d = self.best
        o = np.lexsort((j, d, p))
        p, j, d = p[o], j[o], d[o]
        return self.ids[p], j, (np.arange(len(p)) - np.searchsorted(p, p) + 1).astype(np.int32), d


def within(x: np.ndarray, y: np.ndarray, eps: float, metric: str = "euclidean"):
    """(first row of x, first row of y, which pairs are at most eps apart) of blocks of rows."""
    screen, bound = Screen(x, metric) if metric == "euclidean" else None, np.full(len(x), float(eps))
    for t in range(0, len(y), OTHERS):
        z = y[t : t + OTHERS]
        for s in range(0, len(x), ROWS):
            e = min(s + ROWS, len(x))
            p, q = screen(s, e, z, bound) if screen else (None, None)
            if screen is None or len(p) > (e - s) * len(z) / 4:
                near = distance_block(x[s:e], z, metric) <= eps
            else:
                near = np.zeros((e - s, len(z)), bool)
                near[p, q] = exact(x[s + p], z[q], metric) <= eps
            yield s, t, near
