"""Kernels of embeddings: bandwidth searches, steps of the two layouts over a part of the points, scaling of distances."""

from __future__ import annotations

import numpy as np

from .mesh import Alone

# The curve of attraction for a least distance of 0.1 and a spread of 1.
CURVE = (1.577, 0.8951)
#: Points up to which the pairs are faster than the Fourier transforms of a grid.
DIRECT = 1500
#: Points that are worked on at a time.
ROWS = 8192


def fuzzy_weights(d: np.ndarray) -> np.ndarray:
    """Memberships exp(-(d - nearest) / sigma) of each row's ascending neighbour distances; sigma makes a row sum to log2 of its length."""
    near = np.where(d > 0, d, np.inf).min(axis=1, keepdims=True)
    gap = np.maximum(d - np.where(np.isfinite(near), near, 0), 0)
    want = np.log2(max(d.shape[1], 2))
    lo, hi, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        high = np.exp(-gap / sigma[:, None]).sum(axis=1) > want
        hi, lo = np.where(high, sigma, hi), np.where(high, lo, sigma)
        sigma = np.where(np.isinf(hi), 2 * sigma, (lo + hi) / 2)
    floor = 1e-3 * np.maximum(d.mean(axis=1), 1e-12)
    return np.exp(-gap / np.maximum(sigma, floor)[:, None])


def perplexity_weights(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Gaussian weights of each row's neighbour distances, summing to 1, with the perplexity wanted (less, if there are too few)."""
    s = d * d
    s = s - s.min(axis=1, keepdims=True)
    want = np.log(min(perplexity, max(1.0, d.shape[1] - 1e-9)))
    lo, hi, beta = np.zeros(len(d)), np.full(len(d), np.inf), 1 / np.maximum(s.mean(axis=1), 1e-12)
    for _ in range(64):
        p = np.exp(-s * beta[:, None])
        z = p.sum(axis=1)
        wide = np.log(z) + beta * (s * p).sum(axis=1) / z > want
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), 2 * beta, (lo + hi) / 2)
    p = np.exp(-s * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def attract_epochs(x: np.ndarray, outside: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, rates: np.ndarray, rng: np.random.Generator, negatives: int = 5, curve: tuple[float, float] = CURVE) -> np.ndarray:
    """x after some epochs: an edge (head in x, tail in x and then outside) pulls with probability w, and pushes its head from random points of x.

    Points outside stand still.  An epoch goes in eighths, so that moves see one another.
    """
    a, b = curve
    y, n = np.concatenate([x, outside]), len(x)
    for rate in rates:
        taken = rng.permutation(np.flatnonzero(rng.random(len(w)) < w))
        for part in np.array_split(taken, 8):
            h, t = head[part], tail[part]
            d = y[h] - y[t]
            r = (d * d).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(r > 0, -2 * a * b * r ** (b - 1) / (1 + a * r**b), 0.0)
            g = rate * np.clip(pull[:, None] * d, -4, 4)
            np.add.at(y, h, g)
            own = t < n
            np.add.at(y, t[own], -g[own])
            far = rng.integers(n, size=(len(h), negatives))
            d = y[h][:, None] - y[far]
            r = (d * d).sum(axis=2)
            push = 2 * b / ((0.001 + r) * (1 + a * r**b))
            push[far == h[:, None]] = 0
            np.add.at(y, h, rate * np.clip(push[:, :, None] * d, -4, 4).sum(axis=1))
    return y[:n]


def _nodes(v: np.ndarray, boxes: int, lo: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """First of the three nodes around each value, and the weights of the parabola through them."""
    box = np.clip(((v - lo) / width).astype(int), 0, boxes - 1)
    u = (v - lo) / width - box  # in the box; nodes stand at 1/6, 1/2, 5/6
    at = np.array([1 / 6, 1 / 2, 5 / 6])
    w = np.stack([np.prod([(u - at[m]) / (at[k] - at[m]) for m in range(3) if m != k], axis=0) for k in range(3)], axis=1)
    return 3 * box, w


class Grid:
    """Repulsion of points in the plane by sums over the nodes of a grid: Fourier transforms of charges, interpolated, so the work grows with the points and the grid, not the pairs.

    The grid's width goes in steps of a fiftieth, so that the transforms of the kernels last for many steps.
    """

    def __init__(self):
        self.held = None

    def fit(self, y: np.ndarray) -> Grid:
        """The grid over all points."""
        self.lo = float(y.min())
        span = max(float(y.max()) - self.lo, 1e-9) * (1 + 1e-9)
        span = 1.02 ** np.ceil(np.log(span) / np.log(1.02))
        self.boxes = int(np.clip(np.ceil(1.5 * span), 20, 256))
        while not _smooth(self.boxes):
            self.boxes += 1
        self.width, self.m = span / self.boxes, 3 * self.boxes
        return self

    def _kernels(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held is None or self.held[0] != (self.width, self.m):
            step = np.minimum(np.arange(2 * self.m), 2 * self.m - np.arange(2 * self.m)) * (self.width / 3)
            r = step[:, None] ** 2 + step[None, :] ** 2
            self.held = (self.width, self.m), np.fft.rfft2(1 / (1 + r)).real, np.fft.rfft2((1 + r) ** -2).real
        return self.held[1:]

    def _at(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (px, wx), (py, wy) = _nodes(y[:, 0], self.boxes, self.lo, self.width), _nodes(y[:, 1], self.boxes, self.lo, self.width)
        flat = (px[:, None, None] + np.arange(3)[:, None]) * self.m + py[:, None, None] + np.arange(3)
        return flat.reshape(-1, 9), (wx[:, :, None] * wy[:, None, :]).reshape(-1, 9)

    def potential(self, y: np.ndarray, which: int) -> np.ndarray:
        """Sums of 1 / (1 + r^2)^2 over all points at the nodes, with charge 1 (which: 0) or a coordinate (1, 2); after those of charge 1 the sum over pairs i <> j of 1 / (1 + r^2)."""
        m, g = self.m, 0.0
        for s in range(0, len(y), ROWS):
            flat, w = self._at(y[s : s + ROWS])
            g = g + np.bincount(flat.reshape(-1), (w * y[s : s + ROWS, which - 1 : which] if which else w).reshape(-1), m * m)
        k1, k2 = self._kernels()
        f = np.fft.fft(np.fft.rfft(g.reshape(m, m), 2 * m, axis=1), 2 * m, axis=0)  # rows of zeros need no first transform, rows beyond m no last
        out = np.fft.irfft(np.fft.ifft(f * k2, axis=0)[:m], 2 * m, axis=1)[:, :m].reshape(-1)
        if which:
            return out
        power = (f.real**2 + f.imag**2) * k1
        return np.r_[out, (2 * power.sum() - power[:, 0].sum() - power[:, -1].sum()) / (4 * m * m) - len(y)]

    def forces(self, y: np.ndarray, potentials: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """For some points: (sum over all j of (y_i - y_j) / (1 + r^2)^2, sum over all pairs of 1 / (1 + r^2))."""
        out = np.empty_like(y)
        for s in range(0, len(y), ROWS):
            own = y[s : s + ROWS]
            flat, w = self._at(own)
            one, *by = ((v[flat] * w).sum(axis=1) for v in potentials)
            out[s : s + ROWS] = own * one[:, None] - np.stack(by, axis=1)
        return out, max(float(potentials[0][-1]), 1e-12)


def _smooth(n: int) -> bool:
    for f in (2, 3, 5):
        while n % f == 0:
            n //= f
    return n == 1


def grid_repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """(sum over j of (y_i - y_j) / (1 + r^2)^2, sum over pairs i <> j of 1 / (1 + r^2)) of points in the plane, over a grid."""
    g = Grid().fit(y)
    return g.forces(y, [g.potential(y, c) for c in range(3)])


def repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """The sums of grid_repulsion(): over the pairs where these are few, else over the grid."""
    if len(y) > DIRECT:
        return grid_repulsion(y)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d * d).sum(axis=2))
    return (d * (q * q)[:, :, None]).sum(axis=1), max(float(q.sum()) - len(y), 1e-12)


def neighbour_steps(state: np.ndarray, at: np.ndarray, head: np.ndarray, tail: np.ndarray, p: np.ndarray, rounds: int, exaggeration: float, rate: float, momentum: float, peers) -> np.ndarray:
    """Own points' state (place, speed, gain: two columns each) after some gradient steps of the neighbour embedding, which the peers take together.

    Attraction goes along edges of probability p from own points (head) to any (tail), repulsion
    comes from every point, where it is in that step.  at: the places of own points among all.
    """
    y, speed, gain = (state[:, c : c + 2].copy() for c in (0, 2, 4))
    grid, bounds = Grid(), np.searchsorted(head, np.arange(0, len(y) + ROWS, ROWS))
    for _ in range(rounds):
        every = peers.points(y)
        if len(every) > DIRECT:
            grid.fit(every)
            force, z = grid.forces(y, peers.shared(3, lambda c: grid.potential(every, c)))  # noqa: B023
        else:
            force, z = repulsion(every)
            force = force[at]
        pull = np.empty_like(y)
        for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
            h = head[s:e]
            d = y[h] - every[tail[s:e]]
            f = (exaggeration * p[s:e] / (1 + (d * d).sum(axis=1)))[:, None] * d
            own = slice(k * ROWS, min((k + 1) * ROWS, len(y)))
            pull[own] = np.stack([np.bincount(h - own.start, f[:, c], own.stop - own.start) for c in range(2)], axis=1)
        g = 4 * (pull - force / z)
        gain = np.where((g > 0) == (speed > 0), gain * 0.8, gain + 0.2).clip(0.01)
        speed = momentum * speed - rate * gain * g
        y = y + speed
    return np.concatenate([y, speed, gain], axis=1)


def fresh(x: np.ndarray) -> np.ndarray:
    """The state of points that stand still."""
    return np.concatenate([x, np.zeros_like(x), np.ones_like(x)], axis=1)


def neighbour_epochs(x: np.ndarray, outside: np.ndarray, head: np.ndarray, tail: np.ndarray, p: np.ndarray, share: float, rounds: int, exaggeration: float, rate: float, momentum: float) -> np.ndarray:
    """neighbour_steps() from a standstill, of a cloud that is all here: no point may be outside, and the share is 1."""
    if len(outside) or share != 1:
        raise ValueError("all points must be here: those outside would not push")
    order = np.argsort(head, kind="stable")
    return neighbour_steps(fresh(x), np.arange(len(x)), head[order], tail[order], p[order], rounds, exaggeration, rate, momentum, Alone())[:, :2]


def classical_scaling(d: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates whose distances are nearest to d by double centring, largest axis first, and the axes' eigenvalues; signs by the largest component."""
    s = d * d
    b = -(s - s.mean(axis=0) - s.mean(axis=1)[:, None] + s.mean()) / 2
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    values, vectors = np.maximum(values[::-1][:dims], 0), vectors[:, ::-1][:, :dims]
    if len(d):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    x = vectors * np.sqrt(values)
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))), np.pad(values, (0, dims - len(values)))


def stress_scaling(d: np.ndarray, dims: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Coordinates of least stress by majorisation from the classical ones, and the stress over that of the origin (Kruskal's first, squared)."""
    from .kernels import distance_block

    x, n = classical_scaling(d, dims)[0], len(d)
    total, old = float((d**2).sum()) or 1.0, np.inf
    stress = 0.0
    for _ in range(rounds):
        own = distance_block(x, x)
        stress = float(((d - own) ** 2).sum()) / total
        if old - stress < 1e-9:
            break
        old = stress
        with np.errstate(divide="ignore", invalid="ignore"):
            b = -np.where(own > 0, d / own, 0)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = b @ x / n
    return x, stress
