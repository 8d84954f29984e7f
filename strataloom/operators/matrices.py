"""A user's own distance over clouds (bundle, id, x): its whole matrix is gone through in tiles, and never kept.

A distance is a metric's name or a function of two blocks of rows that gives the distances
of the first's rows to the second's.  Both directions of every pair are worked out; in a check
of the euclidean distance those of which a matrix product, with the bound of its error, shows
that they keep the rules are counted by it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import bipartite_tree, distance_block, minimum_spanning_tree
from ..functions.screen import PAIRS, exact, lawful
from ..sources.scratch import written
from . import diagrams as dg, points as pt

#: Rows and columns of a tile.
TILE = 1024

Distance = str | Callable[[np.ndarray, np.ndarray], np.ndarray]


def _tiles(points: DataFrame, distance: Distance, use: Callable, schema: str) -> DataFrame:
    """What use(bundle, i, j, d, e) yields for each tile: ids of rows and columns, entries, and those of the other half with rows and columns exchanged; e is d for a tile on the diagonal."""
    of = distance if callable(distance) else lambda a, b: distance_block(a, b, distance)

    def both(key, i, j, a, b, diagonal):
        d = np.asarray(of(a, b), float)
        yield from use(key, i, j, d, d if diagonal else np.asarray(of(b, a), float).T)

    return _blocks(points, both, schema)


def _blocks(points: DataFrame, use: Callable, schema: str) -> DataFrame:
    """What use(bundle, i, j, a, b, diagonal) yields for each tile: ids of rows and columns, their coordinates, and if the columns are the rows."""

    class Task:
        def __init__(self, key, rows):
            self.key, self.ids, self.x = key[0], rows["id"].to_numpy(), pt.rows_of(rows["x"])

        def meet(self, rows, own):
            ids, x = rows["id"].to_numpy(), pt.rows_of(rows["x"])
            for t in range(0, len(ids), TILE):
                for s in range(0, t + 1 if own else len(self.ids), TILE):
                    yield from use(self.key, self.ids[s : s + TILE], ids[t : t + TILE], self.x[s : s + TILE], x[t : t + TILE], own and s == t)

        def end(self):
            return ()

    own = points.select(F.col("bundle").cast("string").alias("bundle"), F.col("id").cast("long").alias("id"), "x")
    rows = pt.against(own, ("bundle",), half=True)
    return rows.select("bundle", "a", "side", "id", "x").mapInArrow(pt.meeting(("bundle",), Task), schema)


def _same(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a tile where row and column are of one id."""
    at = np.flatnonzero(np.isin(i, j))
    row, col = np.nonzero(i[at, None] == j[None, :])
    return at[row], col


def _broken(d: np.ndarray, e: np.ndarray, same, tolerance: float, diagonal: bool) -> np.ndarray:
    """Entries of d, and of the other direction e, that break a rule: bad numbers, negative, diagonal, asymmetric.  same: places of one id; diagonal: d holds both directions, and a pair is asymmetric twice."""
    halves = [d] if diagonal else [d, e]
    with np.errstate(invalid="ignore"):
        if all(m.min(initial=0) >= 0 for m in halves) and (np.abs(d - e) <= tolerance).all() and not any((np.abs(m[same]) > tolerance).any() for m in halves):
            return np.zeros(4, np.int64)
        bad = [np.isnan(m) | (m == -np.inf) for m in halves]
        off = ~np.isnan(d) & ~np.isnan(e) & (d != e) & ~(np.abs(d - e) <= tolerance)
        off[same] = False
        return np.array([
            sum(int(b.sum()) for b in bad), sum(int((~b & (m < 0)).sum()) for b, m in zip(bad, halves)),
            sum(int((~b[same] & (np.abs(m[same]) > tolerance)).sum()) for b, m in zip(bad, halves)), int(off.sum()),
        ])


def check(points: DataFrame, distance: Distance = "euclidean", tolerance: float = 1e-6) -> DataFrame:
    """diagrams.check_distances() of all entries of a distance's matrix."""
    counts = ("bad_numbers", "negative", "diagonal", "asymmetric", "_c")
    schema = "bundle string, " + ", ".join(f"{c} long" for c in counts)

    def counted(bundle, found, shape, diagonal):
        found = [*found[:3].tolist(), int(found[3]) // (2 if diagonal else 1), shape[0] * shape[1] * (1 if diagonal else 2)]
        yield pa.record_batch({"bundle": pa.array([bundle], pa.string()), **{c: pa.array([v], pa.int64()) for c, v in zip(counts, found)}})

    def use(bundle, i, j, d, e):
        return counted(bundle, _broken(d, d.T if e is d else e, _same(i, j), tolerance, e is d), d.shape, e is d)

    def screened(bundle, i, j, a, b, diagonal):
        left = ~lawful(a, b, tolerance)
        left[_same(i, j)] = True
        row, col = np.nonzero(left)
        found = np.zeros(4, np.int64)
        for s in range(0, len(row), PAIRS):  # these are worked out
            r, c = row[s : s + PAIRS], col[s : s + PAIRS]
            found += _broken(exact(a[r], b[c], "euclidean"), exact(b[c], a[r], "euclidean"), i[r] == j[c], tolerance, diagonal)
        return counted(bundle, found, left.shape, diagonal)

    if distance is distance_block or distance == "euclidean":
        each = _blocks(points, screened, schema)
    else:
        each = _tiles(points, distance, use, schema)
    nodes = points.groupBy(F.col("bundle").cast("string").alias("bundle")).agg(F.count_distinct("id").alias("n"))
    out = nodes.join(each.groupBy("bundle").agg(*[F.sum(c).alias(c) for c in counts]), "bundle")
    return out.select("bundle", "n", *counts[:4], (F.col("n") * F.col("n") - F.col("_c")).alias("missing"))


def components(points: DataFrame, distance: Distance = "euclidean") -> DataFrame:
    """(bundle, dim, birth, death): diagrams.matrix_diagrams() of dimension 0 of all entries of a distance's matrix.

    A tile gives the edges of its own forest, as others can't be in the whole one.  Entries that break the rules of a distance matrix are an error.
    """

    def use(bundle, i, j, d, e):
        row, col = _same(i, j)
        other = d.T if e is d else e
        if np.isnan(d).any() or np.isnan(other).any() or min(d.min(initial=0), other.min(initial=0)) < 0 or np.abs(d[row, col]).max(initial=0) > 1e-6 or not np.allclose(d, other, atol=1e-6):
            raise ValueError(f"bundle {bundle} holds no distance matrix: see check")
        m = (d + other) / 2
        if e is d:
            np.fill_diagonal(m, 0)
            tree = minimum_spanning_tree(m) + [(0.0, k, k) for k in range(len(i))]  # a loop makes its end a node
        else:
            tree = bipartite_tree(m)
        w, a, b = (np.array(c) for c in zip(*tree))
        yield pa.record_batch({"bundle": pa.array([bundle] * len(w), pa.string()), "u": pa.array(i[a], pa.int64()), "v": pa.array(j[b], pa.int64()), "d": pa.array(w, pa.float64())})

    return dg.graph_diagrams_of(written(_tiles(points, distance, use, "bundle string, u long, v long, d double"), "tiles"), 0)
