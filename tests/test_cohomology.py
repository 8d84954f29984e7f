"""Cohomology against the reduction that lists every simplex; sparse filtrations against whole ones; sampled dimensions."""

import numpy as np
import pytest

from strataloom.functions import cohomology as co
from strataloom.functions.kernels import bottleneck, distance_block, minimum_spanning_tree, reduce_complex, rips
from strataloom.operators import diagrams as dg, mapper as mp, points as pt, series as se


def _listed(d, threshold, coeff):
    """Bars of dimensions 0 and 1 from all simplices."""
    n = len(d)
    cells = [((i,), 0.0) for i in range(n)] + [((i, j), d[i, j]) for i in range(n) for j in range(i + 1, n) if d[i, j] <= threshold]
    cells += [((i, j, k), max(d[i, j], d[i, k], d[j, k])) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if max(d[i, j], d[i, k], d[j, k]) <= threshold]
    return sorted((q, float(b), float(e)) for q, b, e, _, _ in reduce_complex(cells, coeff) if q == 0 or (q == 1 and e > b))


@pytest.mark.parametrize("coeff", [2, 3, 5])
@pytest.mark.parametrize("threshold", [1.1, np.inf])
def test_pairs_equal_the_listed_complex(coeff, threshold):
    r = np.random.default_rng(coeff)
    for n, dims, places in ((1, 2, 9), (2, 2, 9), (18, 2, 9), (16, 3, 1), (15, 8, 9)):  # rounded: ties and copies
        x = np.round(r.normal(size=(n, dims)), places)
        d = distance_block(x, x)
        want = _listed(d, threshold, coeff)
        assert sorted(rips(d, 1, threshold, coeff)) == want
        i, j = np.nonzero(np.triu(np.ones((n, n), bool), 1) & (d <= threshold))
        p = r.permutation(len(i))
        assert sorted(co.pairs(co.Sparse(j[p], i[p], d[i, j][p], n), True, coeff)) == want


def test_a_graph_without_triangles_keeps_its_loop():
    n = 7
    u = np.arange(n)
    bars = co.pairs(co.Sparse(u, (u + 1) % n, np.ones(n), n), True, 3)
    assert sorted(b for b in bars if b[0]) == [(1, 1.0, np.inf)] and sum(b[0] == 0 for b in bars) == n


def test_parallel_edges_and_loops_of_a_graph(spark):
    rows = [("a", 1, 2, 1.0), ("a", 2, 1, 0.5), ("a", 2, 3, 1.0), ("a", 3, 4, 1.0), ("a", 4, 1, 2.0), ("a", 5, 5, 1.0), ("b", 7, 8, None), ("b", 8, 9, 3.0)]
    got = sorted(map(tuple, dg.graph_diagrams_of(spark.createDataFrame(rows, "bundle string, u long, v long, d double")).collect()))
    inf = float("inf")
    assert got == sorted([("a", 0, 0.0, 0.5), ("a", 0, 0.0, 1.0), ("a", 0, 0.0, 1.0), ("a", 0, 0.0, inf), ("a", 0, 0.0, inf), ("a", 1, 2.0, inf), ("b", 0, 0.0, 3.0), ("b", 0, 0.0, inf), ("b", 0, 0.0, inf)])


def test_neighbour_graph_equals_the_matrix_of_its_edges(spark):
    r = np.random.default_rng(4)
    points = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(60)], "id long, x array<double>")
    near = pt.nearest(points, 6).selectExpr("'all' bundle", "least(i, j) u", "greatest(i, j) v", "d").distinct()
    d = np.full((60, 60), np.inf)
    for e in near.collect():
        d[e.u, e.v] = d[e.v, e.u] = e.d
    np.fill_diagonal(d, 0)
    got = sorted((b.dim, b.birth, b.death) for b in dg.graph_diagrams_of(near).collect())
    assert got == sorted(co.pairs(co.Dense(d, d[np.isfinite(d)].max())))


@pytest.mark.parametrize("eps", [0.2, 0.5, 1.0])
def test_sparse_bars_are_within_the_stated_factor(spark, eps):
    r = np.random.default_rng(8)
    t = r.uniform(0, 2 * np.pi, 250)
    x = np.c_[np.cos(t), np.sin(t)] * r.choice([1.0, 3.0], 250)[:, None] + r.normal(scale=0.03, size=(250, 2))
    d = distance_block(x, x)
    whole, edges = co.pairs(co.Dense(d, d.max())), co.sparse_edges(d.__getitem__, 250, eps)
    points = spark.createDataFrame([("c", i, v.tolist()) for i, v in enumerate(x)], "bundle string, id long, x array<double>")
    part = [(b.dim, b.birth, b.death) for b in dg.sparse_diagrams(points, eps).collect()]
    assert len(edges[0]) < 0.6 * 250 * 249 / 2
    for q in (0, 1):
        a, b = (np.array([(max(s, 1e-9), e) for k, s, e in bars if k == q and np.isfinite(e)]) for bars in (whole, part))
        if q:  # a factor is a distance between logarithms
            assert bottleneck(np.log(a), np.log(b)) <= np.log(1 + eps) + 1e-9
        else:
            a, b = np.sort(a[:, 1]), np.sort(b[:, 1])
            assert (np.abs(np.log(a) - np.log(b)) <= np.log(1 + eps) + 1e-9).all()


def test_five_hundred_points_have_loops_in_time():
    r = np.random.default_rng(1)
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    x = np.c_[np.cos(t), np.sin(t)] + r.normal(scale=0.03, size=(400, 2))
    loops = [e - b for q, b, e in rips(distance_block(x, x), 1) if q == 1]
    assert sum(v > 1 for v in loops) == 1


def test_tree_of_points_equals_that_of_the_matrix(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(70, 4))
    d = distance_block(x, x)
    points = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "bundle string, id long, x array<double>")
    for top in (np.inf, 1.5):
        want = sorted(w for w, _, _ in minimum_spanning_tree(np.where(d <= top, d, np.inf)))
        bars = sorted(b.death for b in dg.rips_diagrams(points, 0, top).collect())
        assert np.allclose([b for b in bars if np.isfinite(b)], want) and len(bars) == 70


def test_sampled_dimensions_find_the_dimension(spark):
    r = np.random.default_rng(3)
    rows = [(f"d{k}", i, (r.uniform(size=k).tolist() + [0.0] * (3 - k))) for k in (1, 2, 3) for i in range(700)] + [("few", i, [float(i), 0.0, 0.0]) for i in range(3)]
    points = spark.createDataFrame(rows, "bundle string, id long, x array<double>")
    local = {x.bundle: x for x in se.local_dimension(points, 10, 40, 2).collect()}
    ph = {x.bundle: x for x in se.ph_dimension(points).collect()}
    for k in (1, 2, 3):
        assert abs(local[f"d{k}"]["mean"] - k) < 0.5 and abs(ph[f"d{k}"].dimension - k) < 0.6
    assert ph["few"].n == 3 and ph["few"].dimension != ph["few"].dimension and local["few"].n == 3
    assert {x.bundle: x for x in se.local_dimension(points, 10, 40, 2).collect()} == local


def test_density_lens_of_few_points(spark):
    for n in (1, 2, 100, 250):
        points = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "id long, x array<double>")
        v = {x.id: x.v[0] for x in mp.resolve_lens(points, "density").collect()}
        k = max(1, min(200, n - 1))
        assert v == {i: sorted(abs(i - j) for j in range(n))[k - 1] for i in range(n)}


def test_loops_end_long_before_the_last_edge():
    """A cloud in many dimensions: the work ends with its last loop, and no column is as long as the cloud."""
    x = np.random.default_rng(8).normal(size=(220, 64))
    d = distance_block(x, x)
    seen = []

    class Counted(co.Dense):
        def before(self, e):
            seen.append(e)
            return super().before(e)

    g = Counted(d, float(d.max(axis=1).min()))
    bars = co.pairs(g)
    assert sorted(bars) == sorted(co.pairs(g, True, 3)) and sum(k for k, _, _ in bars) > 200
    assert 0 < len(seen) < g.none / 2
