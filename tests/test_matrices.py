"""A user's own distance in tiles against all its entries as rows."""

import numpy as np
import pytest

from strataloom.functions.kernels import bipartite_tree, distance_block, minimum_spanning_tree
from strataloom.operators import diagrams as dg, matrices as mx, points as pt


def _clouds(spark, sizes):
    r = np.random.default_rng(6)
    rows = [(b, k, np.round(r.normal(size=3), 1).tolist()) for b, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "bundle string, id long, x array<double>"), rows


def _entries(spark, rows, of):
    by = {}
    for b, k, x in rows:
        by.setdefault(b, []).append((k, x))
    out = []
    for b, own in by.items():
        x = np.array([v for _, v in own])
        d = of(x, x)
        out += [(b, own[i][0], own[j][0], float(d[i, j])) for i in range(len(x)) for j in range(len(x))]
    return spark.createDataFrame(out, "bundle string, i long, j long, d double")


def _odd():
    """A distance that breaks every rule somewhere; made here, as tasks don't know this module."""

    def of(a, b):
        d = distance_block(a, b)
        d = np.where(a[:, None, 0] > b[None, :, 0] + 2, d + 1, d)
        d = np.where(a[:, None, 1] > 1.5, np.nan, d)
        d = np.where((a[:, None, 2] < -1) & (b[None, :, 2] > 1), -1.0, d)
        return np.where((a[:, None, 0] < -1) & (b[None, :, 0] < -1), d + 0.5, d)

    return of


@pytest.mark.parametrize("tile", [5, 1024])
def test_tiles_equal_entries(spark, monkeypatch, tile):
    monkeypatch.setattr(mx, "TILE", tile)
    monkeypatch.setattr(pt, "LEAST", 16)
    cloud, rows = _clouds(spark, {"a": 70, "b": 1, "c": 23})
    odd = _odd()
    for of in (distance_block, odd):
        want = sorted(map(tuple, dg.check_distances(_entries(spark, rows, of)).collect()))
        assert sorted(map(tuple, mx.check(cloud, of).collect())) == want
        assert (sum(map(sum, (w[2:6] for w in want))) > 0) == (of is odd)
    bars = lambda t: sorted((b, q, x, round(y, 9)) for b, q, x, y in t.select("bundle", "dim", "birth", "death").collect())
    assert bars(mx.components(cloud, distance_block)) == bars(dg.matrix_diagrams(_entries(spark, rows, distance_block), "distance", 0))
    with pytest.raises(Exception, match="no distance matrix"):
        mx.components(cloud, odd).collect()


def test_bipartite_forest():
    r = np.random.default_rng(7)
    for n, m in ((1, 1), (1, 6), (7, 4), (20, 30)):
        d = np.where(r.random((n, m)) < 0.3, np.inf, np.round(r.random((n, m)), 1))
        square = np.full((n + m, n + m), np.inf)
        square[:n, n:], square[n:, :n] = d, d.T
        tree = bipartite_tree(d)
        assert all(d[a, b] == w for w, a, b in tree)
        assert sorted(w for w, _, _ in tree) == sorted(w for w, _, _ in minimum_spanning_tree(square))


def test_no_entry_is_a_row_of_the_queries(spark):
    """The queries on matrices keep their entries in tasks."""
    from strataloom.plans.queries import QUERIES

    plan = QUERIES["distance_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") <= 3 and "zip_with" not in plan


def test_a_checked_product_leaves_what_it_can_not_vouch_for(spark, monkeypatch):
    """Euclidean entries by products of matrices: copies, near and far points, an id twice, numbers that are none or too large."""
    monkeypatch.setattr(pt, "LEAST", 16)
    monkeypatch.setattr(mx, "TILE", 20)
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(60, 3)), 1)
    x[10:14], x[20], x[30], x[40], x[50] = x[0], x[1] + 1e-9, [np.nan, 0, 0], [np.inf, 1, 1], [1e200, 0, 0]
    x[55:] += 1e7
    rows = [("a", k, v.tolist()) for k, v in enumerate(x)]
    cloud = spark.createDataFrame(rows, "bundle string, id long, x array<double>")
    with np.errstate(all="ignore"):
        want = sorted(map(tuple, dg.check_distances(_entries(spark, rows, distance_block)).collect()))
    assert want[0][2] > 0 and sorted(map(tuple, mx.check(cloud).collect())) == want
    twice = spark.createDataFrame([("a", k % 3, [float(k), 0.0]) for k in range(6)], "bundle string, id long, x array<double>")
    assert tuple(mx.check(twice).first()) == tuple(mx.check(twice, lambda a, b: np.abs(a[:, None, 0] - b[None, :, 0])).first())


def test_products_leave_few_distances_to_work_out():
    from strataloom.functions.screen import lawful

    x = np.random.default_rng(9).normal(size=(300, 64))
    x[7] = x[3]
    row, col = np.nonzero(~lawful(x, x, 1e-6))
    assert set(zip(row.tolist(), col.tolist())) == {*((k, k) for k in range(300)), (3, 7), (7, 3)}
    assert lawful(x[:100], x[100:], 1e-6).all() and not lawful(x, x, 0.0).any()
