"""Searches and dimensions block by block: the same rows as brute force, whatever the size of a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import kernels
from strataloom.functions.kernels import dbscan, dbscan_points, distance_block, geodesic_distances, hdbscan, hdbscan_points, knn_log_statistic, kth_distances, rips, two_nn_dimension
from strataloom.functions.screen import Screen, within
from strataloom.operators import geodesic as geo, mapper as mp, points as pt, preprocess as pp, pruned as pr, series as se, weights as wt


def _x(n=150, dims=4, seed=0, far=0.0):
    x = np.random.default_rng(seed).normal(size=(n, dims)) + far
    x[:6] = x[6]  # copies
    return x


def _table(spark, x, **more):
    rows = [(i, v.tolist(), str(i % 3), i % 4) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, bundle string, label int").repartition(3)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "correlation", "cityblock", "mean_difference", "hamming"])
@pytest.mark.parametrize("far", [0.0, 1e6])
def test_nearest_is_brute_force(spark, metric, far):
    """F34, F37 to F39"""
    x = _x(far=far)
    d = distance_block(x, x, metric)
    want = []
    for i in range(len(x)):
        want.append(np.sort(np.delete(d[i], i))[:5])
    got = np.full((len(x), 5), np.nan)
    for r in pt.nearest(_table(spark, x), 5, metric, block=40).collect():
        got[r.i, r["rank"] - 1] = r.d
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_points_travel_once_a_block(spark):
    """Of n points about n a block are exchanged, and of pairs half of them."""
    p = _table(spark, _x(400))
    assert pt.against(p, (), 100).count() == 400 * 4
    assert pt.against(p, (), 100, True).count() <= 400 * 3
    assert pt.against(p, (), pt.BLOCK).count() == 400


def test_pairs_and_sums_in_blocks(spark):
    """F33, F40, F28"""
    x = _x(90)
    p, d = _table(spark, x), distance_block(x, x)
    for eps in (1.5, float("inf")):
        got = sorted((r.i, r.j, round(r.d, 9)) for r in pt.pairs_within(p, eps, block=25).collect())
        assert got == [(i, j, round(d[i, j], 9)) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= eps]
    for e in (2.0, 3.0, float("inf")):
        got = {r.id: r.v[0] for r in mp.eccentricity_lens(p, e, block=25).collect()}
        want = d.max(axis=1) if np.isinf(e) else (d**e).mean(axis=1) ** (1 / e)
        np.testing.assert_allclose([got[i] for i in range(90)], want)
    r = p.withColumn("r", F.lit(4.0))
    assert sorted(round(v.d, 9) for v in pt.pairs_within(r, 0.5, block=25, scale="r").collect()) == sorted(round(d[i, j] / 4, 9) for i in range(90) for j in range(i + 1, 90) if d[i, j] / 4 <= 0.5)
    gaps = {v.id: v.gap for v in pt.labelled_vertices(p, 1, gamma=9.0, block=10).collect()}
    of = np.arange(90) % 4
    assert sorted(gaps) == sorted(np.flatnonzero(of == 1).tolist())
    np.testing.assert_allclose([gaps[i] for i in sorted(gaps)], d[of == 1][:, of != 1].min(axis=1))


def test_density_counts_every_point(spark, monkeypatch):
    """no sample stands for the cloud."""
    x = _x(9000, 2)
    p = _table(spark, x)
    got = {r.id: r.v for r in mp.codensity(p, 20).collect()}
    some = np.random.default_rng(1).integers(0, 9000, 40)
    np.testing.assert_allclose([got[i] for i in some], [np.sort(d)[19] for d in distance_block(x[some], x)])
    kept = {r.id for r in pp.dense_part(p, 20, 0.3).collect()}
    assert kept == set(sorted(got, key=lambda i: (got[i], i))[:2700])


def test_dimensions_without_matrices(spark):
    """F4, F22 to F24"""
    x = _x(300, 3)
    p = _table(spark, x)
    glob, boot, cal = ({r.bundle: r for r in f(p).collect()} for f in (se.global_dimension, se.bootstrap_dimension, lambda q: se.calibrated_dimension(q, dims=(1, 2, 3, 5), repeats=2)))
    wide = {r.bundle: r for r in se.bootstrap_dimension(p, near=2).collect()}  # too few at first
    for b in range(3):
        own = x[np.arange(300) % 3 == b]
        d = distance_block(own, own)
        assert glob[str(b)].dimension == pytest.approx(two_nn_dimension(d))
        values = []
        for r in range(20):
            pick = np.random.default_rng([0, r]).choice(100, 80, replace=False)
            values.append(two_nn_dimension(d[np.ix_(pick, pick)]))
        assert (boot[str(b)]["mean"], boot[str(b)]["std"]) == pytest.approx((np.mean(values), np.std(values)))
        assert wide[str(b)] == boot[str(b)]
        rows = []
        for dim in (1, 2, 3, 5):
            for r in range(2):
                y = np.random.default_rng([0, dim, r]).normal(size=(100, dim))
                rows.append((knn_log_statistic(distance_block(y, y), 10, 5), np.log(dim)))
        alpha, beta = np.polyfit(*np.array(rows).T, 1)
        assert cal[str(b)].dimension == pytest.approx(np.exp(alpha * knn_log_statistic(d, 10, 5) + beta))
    few = _table(spark, _x(9)[5:])
    assert [np.isnan(r.dimension) for r in se.global_dimension(few).orderBy("bundle").collect()] == [False, True, True]
    assert all(np.isnan(r.dimension) for r in se.calibrated_dimension(few).collect())


def test_gram_views_in_blocks(spark):
    """Products of blocks are those of the join, absent entries too."""
    r = np.random.default_rng(3)
    entries = [(k, i, j, float(r.normal())) for k in range(2) for i in range(40) for j in range(6) if r.random() < 0.3]
    w = spark.createDataFrame(entries, "layer_idx int, i long, j long, w double").repartition(3)
    want = {}
    for k, i, j, v in entries:
        for m, a, b, u in entries:
            if k == m and j == b and i <= a:
                want[k, i, a] = want.get((k, i, a), 0.0) + v * u
    assert len(want) < 2 * 40 * 41 / 2
    for block in (7, 1000):
        got = {(x.layer_idx, x.a, x.b): x.v for x in wt._gram(w, "i", "j", False, block).collect()}
        assert got.keys() == want.keys() and np.allclose([got[x] for x in want], list(want.values()))
    lags = {}
    for (k, a, b), v in want.items():
        lags.setdefault((k, b - a), []).append(v)
    got = {(x.layer_idx, x.lag): x.v for x in wt.matrix_view(w, "gram_diag").collect()}
    assert got.keys() == lags.keys() and np.allclose([got[x] for x in lags], [np.mean(v) for v in lags.values()])
    assert w.schema["layer_idx"] == wt.matrix_view(w, "gram_rows").schema["layer_idx"]
    s = w.select("layer_idx", F.concat(F.lit("n"), "i").alias("i"), F.concat(F.lit("m"), "j").alias("j"), "w")
    assert wt.matrix_view(s, "gram_rows").count() == len(want)


def test_hops_without_matrices(spark):
    """the bars and the middle distance of the matrix of hops."""
    x = np.r_[_x(60, 2, 5), _x(31, 2, 6) + 100]  # in parts
    p = spark.createDataFrame([(i, v.tolist(), str(i // 90)) for i, v in enumerate(x)], "id long, x array<double>, bundle string")
    got = geo.diagrams(p, [1, 2, 4], 0).collect()
    for b, own in (("0", x[:90]), ("1", x[90:])):
        for k in (1, 2, 4):
            d = geodesic_distances(distance_block(own, own), k)
            some = d[d > 0]
            spots = (some.min(), np.median(some), some.max()) if len(some) else (0.0, 0.0, 0.0)
            mine = [r for r in got if (r.bundle, r.k) == (b, k)]
            assert sorted((r.birth, r.death) for r in mine) == sorted((s, e) for _, s, e in rips(d, 0))
            assert {(r.lo, r.mid, r.hi) for r in mine} == {spots}


def test_pruned_search_sends_in_pieces(spark, monkeypatch):
    """what goes to the parts is never made for a whole batch."""
    monkeypatch.setattr(pr, "_ROWS", 7)
    p = _table(spark, _x(200))
    key = lambda df: sorted((r.i, r["rank"], r.j, round(r.d, 9)) for r in df.collect())
    assert key(pr.nearest(p, 4, pivots=20, block=40)) == key(pt.nearest(p, 4))


@pytest.mark.parametrize("eps", [0.3, 1.0, 9.0])
def test_dbscan_of_screened_pairs(eps):
    """the labels of the matrix, and pairs that are not worked out when they are far apart."""
    x = _x(700, 3)
    d = distance_block(x, x)
    assert (dbscan_points(x, eps, 5) == dbscan(d, eps, 5)).all()
    np.testing.assert_array_equal(kth_distances(x, 5), np.sort(d, axis=1)[:, 5])
    near = np.zeros(d.shape, bool)
    for s, t, block in within(x, x, eps):
        near[s : s + block.shape[0], t : t + block.shape[1]] = block
    assert (near == (d <= eps)).all()
    assert len(Screen(x, "euclidean")(0, 100, x, np.full(700, 0.3))[0]) < 0.1 * 100 * 700


def test_hdbscan_of_bounded_rows(monkeypatch):
    """the labels of the matrix; rows of the tree work out few distances."""
    x = np.r_[_x(300, 3), _x(300, 3, 1) + 6]
    assert (hdbscan_points(x, 5) == hdbscan(distance_block(x, x), 5)).all()
    made, real = [0], kernels.distance_block
    monkeypatch.setattr(kernels, "distance_block", lambda a, b, *m: (made.__setitem__(0, made[0] + len(a) * len(b)), real(a, b, *m))[1])
    hdbscan_points(x, 5)
    assert made[0] < 600**2 / 3
