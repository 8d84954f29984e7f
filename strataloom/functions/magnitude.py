"""Magnitudes of a cloud at many scales in memory that grows with its points: conjugate gradients, whose products go over blocks of distances."""

from __future__ import annotations

import numpy as np

from .screen import exact

#: Rows and columns of a block, and values sorted at a time.
ROWS, COLUMNS, VALUES = 256, 2048, 1 << 22


def _blocks(x: np.ndarray):
    """(rows, columns, distances, whether on the diagonal) of one half of the matrix; blocks on the diagonal are whole."""
    z = x - x.mean(axis=0)
    size = (z * z).sum(axis=1)
    for s in range(0, len(x), ROWS):
        e = min(s + ROWS, len(x))
        for a, b in [(s, e), *[(c, min(c + COLUMNS, len(x))) for c in range(e, len(x), COLUMNS)]]:
            both = size[s:e, None] + size[None, a:b]
            d = both - 2 * (z[s:e] @ z[a:b].T)
            i, j = np.nonzero(d <= 1e-6 * both)  # a difference of near numbers: worked out anew
            d = np.sqrt(np.maximum(d, 0, out=d), out=d)
            d[i, j] = exact(x[s + i], x[a + j], "euclidean")
            yield slice(s, e), slice(a, b), d, a == s


def _halves(x: np.ndarray):
    """Positive distances, each pair once."""
    for _, _, d, own in _blocks(x):
        v = d[np.triu_indices(len(d), 1)] if own else d.reshape(-1)
        yield v[v > 0]


def median_distance(x: np.ndarray) -> float:
    """The median of the positive distances, by counts over ever narrower ranges."""
    whole = 2 * float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).max())) * (1 + 1e-9)
    m = sum(len(v) for v in _halves(x))
    if not m:
        return float("nan")

    def place(k: int) -> float:
        lo, hi, before = 0.0, whole, 0
        while True:
            edges = np.linspace(lo, hi, 1 << 12)
            counts = np.zeros(len(edges) + 1, np.int64)
            for v in _halves(x):
                v = v[(v >= lo) & (v <= hi)]
                counts += np.bincount(np.searchsorted(edges, v, side="right"), minlength=len(counts))
            upto = before + np.cumsum(counts)
            at = int(np.searchsorted(upto, k, side="right"))
            a, b = edges[max(at - 1, 0)], edges[min(at, len(edges) - 1)]
            if counts[at] <= VALUES:
                some = np.sort(np.concatenate([v[(v >= a) & ((v < b) | (at == len(edges)))] for v in _halves(x)]))
                return float(some[k - int(upto[at] - counts[at])])
            if b - a <= 1e-14 * whole:
                return float(a)
            lo, hi, before = a, np.nextafter(b, 0), int(upto[at] - counts[at])

    return (place((m - 1) // 2) + place(m // 2)) / 2 if m % 2 == 0 else place(m // 2)


def magnitudes(x: np.ndarray, t: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """The sums of the weights w with exp(-t d) w = 1, for each scale t.

    A step adds its length times the squared residual to the sum, and what is left is the sum
    of all later such terms; it ends when the last four come to no more than the tolerance's share.
    """
    n = len(x)
    total, last, r = np.zeros(len(t)), np.full((4, len(t)), np.inf), np.ones((len(t), n))
    p, rr = r.copy(), np.full(len(t), float(n))
    live = np.arange(len(t))
    for k in range(4 * n + 50):
        y = np.zeros_like(p)
        for rows, columns, d, own in _blocks(x):
            least = float(d.min())
            for c in live.tolist():
                if t[c] * least > 80 + np.log(n):  # under a double's precision beside the diagonal
                    continue
                z = np.exp(d * -t[c])
                y[c, rows] += z @ p[c, columns]
                if not own:
                    y[c, columns] += p[c, rows] @ z
        step = rr[live] / (p[live] * y[live]).sum(axis=1)
        last[k % 4, live] = step * rr[live]
        total[live] += last[k % 4, live]
        r[live] -= step[:, None] * y[live]
        new = (r[live] ** 2).sum(axis=1)
        p[live] = r[live] + (new / rr[live])[:, None] * p[live]
        rr[live] = new
        live = live[(new > 1e-24 * n) & ~(last[:, live].sum(axis=0) <= tolerance * total[live])]
        if not len(live):
            return total
    raise ArithmeticError(f"no magnitude of {n} points: the weights did not settle")
