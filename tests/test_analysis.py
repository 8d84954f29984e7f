import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import kernels as k, transport as tr
from strataloom.operators import compare as cp, geodesic as geo, mapper as mp, points as pt, preprocess as pp, series as se, views as vw, weights as wt
from strataloom.plans.analysis import Analysis, neurons
from strataloom.plans.presets import PRESETS, describe


def _cloud(spark, x, bundle="b", label=None):
    rows = [(bundle, i, v.tolist(), int(label[i]) if label is not None else 0) for i, v in enumerate(np.asarray(x, float))]
    return spark.createDataFrame(rows, "bundle string, id long, x array<double>, label int")


def test_transport_matches_an_assignment():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 20):
        c = rng.random((n, n))
        u = np.full(n, 1 / n)
        assert (tr.transport(u, u, c) * c).sum() == pytest.approx(c[np.arange(n), k.assignment(c)].mean())
    p, q, c = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(8)), rng.random((5, 8))
    plan = tr.transport(p, q, c)
    assert np.allclose(plan.sum(axis=1), p) and np.allclose(plan.sum(axis=0), q) and plan.min() >= -1e-12
    x, y = np.sort(rng.random(5)), np.sort(rng.random(8))  # on a line the plan is the monotone one
    c = (x[:, None] - y[None, :]) ** 2
    grid = np.unique(np.r_[0, np.cumsum(p), np.cumsum(q)].round(12))
    mid = (grid[1:] + grid[:-1]) / 2
    want = sum(w * c[min(np.searchsorted(np.cumsum(p), m), 4), min(np.searchsorted(np.cumsum(q), m), 7)] for w, m in zip(np.diff(grid), mid))
    assert (tr.transport(p, q, c) * c).sum() == pytest.approx(want, abs=1e-9)


def test_comparisons_of_graphs(spark):
    rows = [("one", f"n{i // 3}", i) for i in range(12)] + [("one", f"n{i // 3 + 1}", i) for i in range(2, 9, 3)]
    rows += [("two", n, i) for g, n, i in rows if g == "one"] + [("three", "x", i) for i in range(12)]
    m = spark.createDataFrame(rows, "graph string, node string, id long")
    pairs = spark.createDataFrame([("one", "two"), ("one", "three")], "a string, b string")
    for method in ("hypernetwork", "hypergraph", "graph"):
        d = {r["b"]: r["distance"] for r in cp.distances(m, pairs, method, restarts=20).collect()}
        assert d["three"] > 0.05 and d["two"] <= d["three"] + 1e-9, method
    with pytest.raises(ValueError):
        cp.distances(m, pairs, "other")


def test_patterns_stand_for_their_members():
    m = np.array([[1, 0, 0], [1, 1, 0], [0, 1, 1], [0, 0, 1]], bool)
    n = np.array([2, 1, 1, 3])
    whole = np.repeat(m, n, axis=0)
    a, b = tr.hypernetwork(m, n), tr.hypernetwork(whole, np.ones(len(whole), int))
    assert np.allclose(np.repeat(a[0], n, axis=0), b[0]) and np.allclose(a[2], b[2])
    assert np.allclose(np.repeat(a[1] / n, n), b[1])


def test_hdbscan_finds_dense_groups_and_noise():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), rng.normal([0, 9], 0.5, (30, 2)), [[40.0, 40.0]]]
    labels = k.hdbscan(k.distance_block(x, x), 5)
    groups = [labels[i : i + 30] for i in (0, 30, 60)]
    assert [np.bincount(g[g >= 0]).argmax() for g in groups] == [0, 1, 2]
    assert all((g == np.bincount(g[g >= 0]).argmax()).mean() > 0.8 for g in groups) and labels[90] == -1


def test_geodesics_and_stable_k(spark):
    t = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    x = np.c_[np.cos(t), np.sin(t)]
    d = k.geodesic_distances(k.distance_block(x, x), 2)
    assert d.max() == 12 and (d == d.T).all() and d[0, 1] == 1
    df = _cloud(spark, x)
    grid = geo.betti_grid(df, [2, 4, 6], 1, 6)
    assert grid.count() == 3 * 6 * 2
    one = {r["dim"]: r["betti"] for r in grid.filter("k = 2 and step = 1").collect()}
    assert one == {0: 1, 1: 1}  # a ring: at hop 3.2 still one loop
    assert geo.optimal_k(df, [2, 3, 4, 5, 6]).first()["k"] == 2
    cell = geo.stable_cell(grid).first()
    assert cell["k"] in (2, 4, 6)


def test_views(spark):
    w = np.arange(16 * 2 * 3 * 5, dtype=float).reshape(16, 2, 3, 5)
    rows = [(0, *map(int, i), float(v)) for i, v in np.ndenumerate(w)]
    df = spark.createDataFrame(rows, "layer_idx int, o long, i long, h long, w long, v double").repartition(3)
    want = {"rows": w.reshape(-1, 5), "cols": w.transpose(0, 1, 3, 2).reshape(-1, 3), "kernel": w.reshape(32, 15), "out_channel": w.reshape(16, 30), "in_channel": w.transpose(1, 0, 2, 3).reshape(2, -1), "tap": w.transpose(2, 3, 0, 1).reshape(15, -1)}
    for view, m in want.items():
        got = vw.conv_view(df, view)
        got = np.array([r["x"] for r in got.orderBy(*got.columns[1:-1]).collect()])
        assert got.shape == vw.conv_view_shape(w.shape, view) and np.array_equal(got, m)
    with pytest.raises(Exception, match="one coordinate"):
        vw.conv_view(df.filter("w = 0"), "rows").collect()
    assert vw.view_shape((84, 15), "gram_rows") == (1, 3570) and vw.view_shape((84, 15), "gram_rows", "full") == (1, 7056) and vw.view_shape((84, 15), "rows") == (84, 15)


def test_gram_view_keeps_its_diagonal(spark):
    m = np.arange(12, dtype=float).reshape(3, 4)
    w = spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(3) for j in range(4)], "layer_idx int, i long, j long, w double")
    got = {(r["a"], r["b"]): r["v"] for r in wt.matrix_view(w, "gram_rows").collect()}
    assert len(got) == 6 and all(v == (m @ m.T)[a, b] for (a, b), v in got.items())
    got = {(r["a"], r["b"]): r["v"] for r in wt.matrix_view(vw.normalise_rows(w, "correlation"), "gram_rows").collect()}
    assert got[0, 1] == pytest.approx(np.corrcoef(m)[0, 1])


def test_preparing_steps(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    df = _cloud(spark, x).select("id", "x")
    got = np.array([r["x"] for r in pp.prepare(df, ["mean_centre", "l2"]).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    assert np.allclose(got, c / np.linalg.norm(c, axis=1, keepdims=True))
    near = np.sort(k.distance_block(x, x), axis=1)[:, 4]
    assert {r["id"] for r in pp.prepare(df, ("density", 5, 0.3)).collect()} == set(np.argsort(near)[:15].tolist())
    n = np.linalg.norm(x, axis=1)
    assert {r["id"] for r in pp.prepare(df, ("norm", 40.0, "low")).collect()} == set(np.flatnonzero(n <= np.percentile(n, 40)).tolist())
    ties = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(10)], "id long, x array<double>")
    assert [r["id"] for r in pp.prepare(ties, ("density", 2, 0.5)).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        pp.prepare(df, "whiten")


def test_overlap_conventions_and_dense_copies(spark):
    assert round(mp.convert_overlap(0.67), 3) == 0.401 and round(mp.convert_overlap(0.67, "standard", "width_ratio"), 2) == 2.03
    x = [[0.0]] * 4 + [[5.0], [9.0]]
    assert {r["id"] for r in pt.density_filter(_cloud(spark, x), 2, 0.5).collect()} == {0, 1, 2, 3}  # copies are infinitely dense


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_clusters_from_blocks_match_those_from_the_matrix(metric, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 0.3, (60, 3)), rng.normal(3, 0.5, (50, 3)), rng.uniform(-3, 6, (40, 3))]
    x[5] = x[6]
    d, whole = k.distance_block(x, x, metric), k.row_blocks
    monkeypatch.setattr(k, "row_blocks", lambda x, metric: whole(x, metric, 1000))  # blocks of six rows
    for few in (3, 5, 10):
        assert k.elbow_points(x, few, metric) == k.elbow(d, few)
        assert (k.hdbscan_points(x, few, metric) == k.hdbscan(d, few)).all()
        for eps in (0.3, 0.6, 1.5):
            assert (k.dbscan_points(x, eps, few, metric) == k.dbscan(d, eps, few)).all()


def test_density_clusterers_take_cells_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.1, (8200, 2)) + np.repeat([[0.0, 0.0], [5.0, 5.0]], 4100, axis=0)
    pts = _cloud(spark, x)
    cells = pts.select("id", F.lit("a").alias("cell"))
    for how in ({"clusterer": "dbscan", "eps": 1.0, "min_samples": 5}, {"clusterer": "hdbscan", "min_cluster_size": 2000}):
        got = mp.cluster_cells(pts, cells, **how)
        assert {(r["label"], r["half"]) for r in got.select("label", (F.col("id") >= 4100).alias("half")).distinct().collect()} == {(0, False), (1, True)}, how


def test_skipped_cells_are_counted(spark):
    pts = _cloud(spark, np.r_[np.arange(6.0), [50.0, 51.0]][:, None])
    cells = pts.select("id", F.when(F.col("id") < 6, "a").otherwise("b").alias("cell"))
    r = mp.graph_measures(mp.cluster_cells(pts, cells, "single", max_cell=4, cut=1.5)).first()
    assert (r["nodes"], r["covered"], r["skipped"]) == (1, 2, 1)
    r = mp.graph_measures(mp.cluster_cells(pts, cells, "single", max_cell=1, cut=1.5)).first()
    assert (r["nodes"], r["covered"], r["skipped"]) == (0, 0, 2)
    assert mp.graph_measures(mp.cluster_cells(pts, cells, "dbscan", max_cell=4, eps=1.5, min_samples=1)).first()["skipped"] == 0


def test_graph_measures(spark):
    e = spark.createDataFrame([("g", a, b, 1.0) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (8, 9))], "bundle string, u long, v long, w double")
    r = mp.graph_statistics(e).first()
    assert (r["nodes"], r["edges"], r["b0"], r["b1"], r["diameter"]) == (6, 5, 2, 1, 2)
    assert r["density"] == pytest.approx(1 / 3) and r["clustering"] == pytest.approx((1 + 1 + 1 / 3) / 6)
    square = spark.createDataFrame([("g", a, (a + 1) % 4, 2.0) for a in range(4)], "bundle string, u long, v long, w double")
    bars = mp.graph_diagrams(square).collect()
    assert sum(b["dim"] == 1 and b["birth"] == 0 and b["death"] == 2 for b in bars) == 1


def test_every_preset_runs(spark):
    rng = np.random.default_rng(2)
    pts = _cloud(spark, rng.normal(size=(60, 4)), label=np.arange(60) % 2)
    w = spark.createDataFrame([(q, i, j, float(rng.normal())) for q, (n, m) in enumerate(((4, 5), (5, 3))) for i in range(n) for j in range(m)], "layer_idx int, i long, j long, w double")
    acts = spark.createDataFrame([(q, i, float(rng.random())) for q, n in enumerate((4, 5)) for i in range(n)], "layer_idx int, i long, a double")
    small = {"naitzat2020": {"builder__k_range": (2, 6)}, "birdal2021": {"tool__sizes": (20, 40, 60)}, "dupuis2023": {"tool__sizes": (20, 40, 60)}, "ong2026": {"tool__dims": (1, 2, 4), "tool__repeats": 1}}
    for name in PRESETS:
        a = Analysis.from_preset(name, **small.get(name, {}))
        assert a.fit(w, acts).count() > 0 if a.builder == "weight_graph" else a.fit(pts).count() > 0, name
        assert name in describe(name) and a.explain()


def test_analysis_rejects_what_cannot_work(spark):
    with pytest.raises(ValueError):
        Analysis("weight_graph", "ph", {"induced_paths": True})
    with pytest.raises(ValueError):
        Analysis.from_preset("nobody")
    with pytest.raises(ValueError):
        Analysis.from_preset("rieck2019", max_dim=1)
    with pytest.warns(UserWarning):
        Analysis("weight_graph", "mapper")


def test_many_tables_and_neurons(spark):
    x = np.random.default_rng(3).normal(size=(20, 3))
    two = Analysis(None, "dimension", None, {"method": "global"}).fit_many({"a": _cloud(spark, x), "b": _cloud(spark, x)})
    d = {r["bundle"]: r["dimension"] for r in two.collect()}
    assert set(d) == {"a/b", "b/b"} and d["a/b"] == d["b/b"] == pytest.approx(k.two_nn_dimension(k.distance_block(x, x)))
    flat = np.c_[x, np.ones(20)]
    kept = neurons(_cloud(spark, flat), True).orderBy("id").collect()
    assert [r["id"] for r in kept] == [0, 1, 2] and np.allclose(kept[1]["x"], x[:, 1])
    assert neurons(_cloud(spark, flat), True, 2).count() == 2
    boot = se.bootstrap_dimension(_cloud(spark, x), 4).first()
    assert boot["mean"] > 0 and boot["std"] >= 0
