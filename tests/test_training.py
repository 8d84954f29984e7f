"""Layers, series over training, graph features, matrix inputs and Mapper grids, against brute force and known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.kernels import bottleneck, rips, wasserstein
from strataloom.operators import diagrams as dg, graphs as gr, layers as ly, mapper as mp, series as se, training as tr, weights as wt
from strataloom.plans import grid as pg


def _matrix(spark, m, layer=0):
    return [(layer, int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]


W = "layer_idx int, i long, j long, w double"


def test_layer_selections(spark):
    layers = spark.createDataFrame([(0, "conv1", "conv", 9), (1, "norm", "norm", 0), (2, "fc1", "linear", 20), (3, "fc2", "linear", 6), (4, "emb", "embedding", 5)], "layer_idx int, name string, kind string, params long")
    got = lambda s: [r["name"] for r in ly.select_layers(layers, s).orderBy("layer_idx").collect()]
    assert got("all_linear") == ["fc1", "fc2"] and got("all_conv") == ["conv1"] and got("linear_and_conv") == ["conv1", "fc1", "fc2"]
    assert got("all") == ["conv1", "fc1", "fc2", "emb"] and got("all_embedding") == ["emb"] and got("soro") == []
    assert got(["fc2"]) == ["fc2"] and got([0, -1]) == ["conv1", "emb"]
    with pytest.warns(UserWarning):
        assert got(None) == ["fc1", "fc2"]
    assert [r["name"] for r in ly.select_layers(layers.filter("kind <> 'linear'")).collect()] == ["conv1"]
    for bad, error in (("dense", ValueError), (["fc9"], KeyError), ([7], IndexError)):
        with pytest.raises(error):
            ly.select_layers(layers, bad)
    with pytest.raises(KeyError):
        ly.layer_of(layers, "fc9", "name")
    assert ly.layer_of(layers, "fc1", "name").count() == 1


def test_factored_and_coupled(spark):
    r = np.random.default_rng(0)
    u, s, v = r.normal(size=(3, 2)), r.normal(size=2), r.normal(size=(4, 2))
    rows = lambda m, names: spark.createDataFrame([(0, int(a), int(b), float(m[a, b])) for a in range(m.shape[0]) for b in range(m.shape[1])], names)
    got = ly.effective_weights(rows(u, "layer_idx int, j long, r long, u double"), spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(s)], "layer_idx int, r long, s double"), rows(v, "layer_idx int, i long, r long, v double"))
    want = (v * s) @ u.T
    assert all(abs(x.w - want[x.i, x.j]) < 1e-9 for x in got.collect()) and got.count() == 12
    w = spark.createDataFrame(_matrix(spark, np.ones((3, 2))), W)
    acts = lambda n: spark.createDataFrame([(0, -1, i, float(i)) for i in range(n)], "sample long, layer_idx int, i long, a double")
    assert sorted((x.i, x.a) for x in ly.coupled(w, acts(6)).collect()) == [(0, 3.0), (1, 4.0), (2, 5.0)]
    with pytest.raises(Exception, match="takes 3 values but is given 4"):
        ly.coupled(w, acts(4)).collect()


def test_population_cloud(spark):
    r = np.random.default_rng(1)
    m = {k: r.normal(size=(2, 3)) for k in ("a", "b")}
    w = spark.createDataFrame([(k, *x) for k, v in m.items() for x in _matrix(spark, v)], "member_id string, " + W)
    flat = {x.member_id: x.x for x in ly.population_cloud(w, "full", "l2").collect()}
    assert all(np.allclose(flat[k], v.reshape(-1) / np.linalg.norm(v)) for k, v in m.items())
    rows = ly.population_cloud(w, "rows", "mean_centre")
    mean = np.concatenate(list(m.values())).mean(axis=0)
    assert all(np.allclose(x.x, m[x.member_id][x.n] - mean) for x in rows.collect())
    assert [(x.id, x.member_id, x.n) for x in ly.member_index(rows).orderBy("id").collect()] == [(0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "b", 1)]
    norm = {x.member_id: x.x for x in ly.population_cloud(w, "col_norm").collect()}
    assert all(np.allclose(norm[k], np.linalg.norm(v, axis=0)) for k, v in m.items())


def test_spectral_norms(spark):
    r = np.random.default_rng(2)
    m = [r.normal(size=(5, 3)), r.normal(size=(3, 7))]
    got = {x.layer_idx: x for x in tr.spectral_norms(spark.createDataFrame(_matrix(spark, m[0]) + _matrix(spark, m[1], 1), W), "layer_idx").collect()}
    for k, x in enumerate(m):
        s = np.linalg.svd(x, compute_uv=False)
        assert abs(got[k].l2 - s[0]) < 1e-9 and abs(got[k].nuc - s.sum()) < 1e-7


def test_diagram_distances(spark):
    r = random.Random(3)
    d = {s: [(b := r.random(), b + r.random()) for _ in range(4)] for s in range(4)}
    rows = [(s, 1, *x) for s, v in d.items() for x in v] + [(4, 1, 0.0, math.inf)]
    df = spark.createDataFrame(rows, "step int, dim int, birth double, death double")
    for how, pairs in (("previous", {(0, 1), (1, 2), (2, 3), (3, 4)}), ("final", {(4, s) for s in range(5)}), ("initial", {(0, s) for s in range(5)}), ("all", {(a, b) for a in range(5) for b in range(a + 1, 5)})):
        got = {(x.a, x.b): x for x in tr.diagram_distances(df, how).collect()}
        assert set(got) == pairs
        for (a, b), x in got.items():
            if 4 in (a, b):
                assert math.isnan(x.wasserstein)
            else:
                assert abs(x.wasserstein - wasserstein(np.array(d[a]), np.array(d[b]))) < 1e-9 and abs(x.bottleneck - bottleneck(np.array(d[a]), np.array(d[b]))) < 1e-9


def test_trajectory_measures_and_windows(spark):
    r = np.random.default_rng(4)
    data = spark.createDataFrame([(s, k, r.normal(size=3).tolist()) for s in (1, 2) for k in range(20)] + [(3, 0, [0.0, 0.0, 0.0])], "step int, id long, x array<double>")
    got = tr.trajectory_measures(data, lambda t: se.global_dimension(t).filter("n > 1"), ["n", "dimension"])
    by = {(x.epoch, x.measure): x.value for x in got.collect()}
    assert by[1, "n"] == 20 and by[2, "dimension"] > 0 and math.isnan(by[3, "n"]) and len(by) == 6
    walk = spark.createDataFrame([(s, c, float(v)) for s in range(40) for c, v in enumerate((s, s * 2))], "step int, coord int, v double")
    w = tr.windowed_dimension(walk, 20, 10, "ph").orderBy("win").collect()
    assert [(x.win, x.centre) for x in w] == [(0, 10), (10, 20), (20, 30)]
    assert [(x.want, x.step) for x in ly.snapshot_at(walk, spark.createDataFrame([(-3.0,), (2.5,), (2.6,), (90.0,)], "want double")).orderBy("want").collect()] == [(-3.0, 0), (2.5, 2), (2.6, 3), (90.0, 39)]
    assert [x.step for x in ly.checkpoints(walk, 4).orderBy("step").collect()] == [0, 13, 26, 39] and ly.checkpoints(walk, 99).count() == 40


def test_settle_follows_the_rule(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for key in range(60):
        n = int(r.integers(3, 40))
        v = np.exp(-np.arange(n) / r.uniform(1, 12)) + r.normal(size=n) * r.choice([0.0, 0.2])
        rows += [(key, i, float(x)) for i, x in enumerate(v)]
        s = np.convolve(np.pad(v, 2, mode="edge"), np.ones(5) / 5, mode="valid")
        early, late = np.median(s[: max(5, n // 8)]), np.median(s[-15:])
        want[key] = None
        if n >= 7 and early != late:
            z = (s - late) / (early - late)
            ok = [i for i in range(n) if (z[i:] <= 0.1).all()]
            want[key] = ok[0] if ok else None
    got = {x.key: x.settled for x in se.settle(spark.createDataFrame(rows + [(0, 99, float("nan"))], "key int, step int, v double")).collect()}
    assert got == want and any(v is not None for v in want.values())


def test_centrality_and_clustering(spark):
    # a triangle with a tail, and a pair apart
    e = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 1.0), ("g", "c", "d", 1.0), ("g", "x", "y", 1.0)], "bundle string, u string, v string, w double")
    c = {x.node: x for x in gr.centrality(e).collect()}
    assert abs(c["c"].betweenness - 2 / 10) < 1e-9 and c["a"].betweenness == c["d"].betweenness == 0  # two of the ten pairs of others
    assert abs(c["c"].closeness - 3 / 3 * 3 / 5) < 1e-9 and abs(c["d"].closeness - 3 / 5 * 3 / 5) < 1e-9 and abs(c["x"].closeness - 1 / 5) < 1e-9
    k = {x.node: x.clustering for x in gr.clustering(e).collect()}
    assert abs(k["a"] - 1) < 1e-9 and abs(k["c"] - 1 / 3) < 1e-9 and k["d"] == k["x"] == 0


def test_pathways(spark):
    e = spark.createDataFrame([("g", "a", "b", 5.0), ("g", "b", "c", 1.0), ("g", "c", "d", -4.0), ("g", "a", "d", 0.5)], "bundle string, u string, v string, w double")
    got = {(x.u, x.v): (x.w, x.role, x.cluster) for x in gr.pathways(e, 2).collect()}
    assert got == {("a", "b"): (5.0, "tree", 0), ("c", "d"): (4.0, "tree", 1), ("b", "c"): (1.0, "death", None)}
    assert {x.role for x in gr.pathways(e, 1).collect()} == {"tree"}


def test_loop_mask_keeps_loops_first(spark):
    r = np.random.default_rng(6)
    m = [r.normal(size=(4, 3)), r.normal(size=(3, 3))]
    w = spark.createDataFrame(_matrix(spark, m[0]) + _matrix(spark, m[1], 1), W)
    bars = wt.clique_diagram(wt.clique_relevance(w))
    loops = sorted(((b.birth + b.death, b.birth, ",".join(b.birth_edge), ",".join(b.death_triangle), {*b.birth_edge, *b.death_triangle}) for b in bars.collect() if b.dim == 1 and b.death < math.inf), key=lambda x: x[:4])
    assert loops
    every = {f"{k}:{i}:{j}": abs(x[i, j]) for k, x in enumerate(m) for i in range(x.shape[0]) for j in range(x.shape[1])}
    for ratio in (0.1, 0.5, 0.9, 0.99):
        budget, want = round((1 - ratio) * len(every)), set()
        for *_, edges in loops:
            if len(want) >= budget:
                break
            want |= edges
        for e in sorted(every, key=lambda e: -every[e]):
            if len(want) >= budget:
                break
            want.add(e)
        got = {f"{x.layer_idx}:{x.i}:{x.j}" for x in wt.loop_mask(w, bars, ratio).filter("kept").collect()}
        assert got == want


def test_schedules(spark):
    d = spark.createDataFrame([("a", 0, 0.0, 2.0), ("a", 0, 1.0, 5.0)], "bundle string, dim int, birth double, death double")
    assert dg.schedule(6, d) == [0, 1, 2, 3, 4, 5] and dg.schedule((3, 1)) == [3.0, 1.0] and dg.schedule(3, d.limit(0)) == [0.0]
    steps = dg.schedule({"type": "log_decades"})
    assert len(steps) == 64 and np.allclose(steps[:10], [1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]) and abs(steps[-1] - 1e-7) < 1e-15
    assert np.allclose(steps, wt.clique_schedule())
    assert np.allclose(dg.schedule({"type": "log", "min": 1, "max": 100, "n": 3}), [1, 10, 100]) and dg.schedule({"min": 0, "max": 1, "n": 3}) == [0, 0.5, 1]
    for bad, error in (({"type": "x"}, ValueError), ("x", TypeError), (5, ValueError)):
        with pytest.raises(error):
            dg.schedule(bad)
    got = [(x.birth, x.death) for x in dg.snap_index(d, [5.0, 1.0, 0.0]).orderBy("birth").collect()]
    assert sorted(got) == [(1.0, 0.0), (2.0, 1.0)]
    assert dg.prune(d, 3.0).count() == 1 and dg.infinity_line(d).first()["line"] == 5.5


def test_matrix_inputs(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(8, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    entries = [("m", i, j, float(d[i, j])) for i in range(8) for j in range(8)]
    S = "bundle string, i long, j long, d double"
    want = sorted((k, round(b, 9), round(e, 9)) for k, b, e in rips(d, 1))
    for rows in (entries, [e for e in entries if e[1] < e[2]]):
        assert sorted((b.dim, round(b.birth, 9), round(b.death, 9)) for b in dg.matrix_diagrams(spark.createDataFrame(rows, S)).collect()) == want
    knn = [e for e in entries if e[2] in np.argsort(d[e[1]])[1:4]]
    g = np.zeros((8, 8))
    for _, i, j, v in knn:
        g[i, j] = v
    full = np.where((g > 0) | (g.T > 0), (g + g.T) / 2, 2 * g.max() + 1)
    np.fill_diagonal(full, 0)
    assert sorted((b.dim, round(b.birth, 9), round(b.death, 9)) for b in dg.matrix_diagrams(spark.createDataFrame(knn, S), "knn").collect()) == sorted((k, round(b, 9), round(e, 9)) for k, b, e in rips(full, 1))
    sim = dg.matrix_diagrams(spark.createDataFrame([("s", 0, 1, 3.0), ("s", 1, 2, 1.0)], S), "similarity", 0)
    assert sorted(b.death for b in sim.collect()) == [0.0, 2.0, math.inf]
    c = dg.check_distances(spark.createDataFrame([("m", 0, 1, 1.0), ("m", 1, 0, 2.0), ("m", 0, 0, 0.5), ("m", 1, 2, float("nan")), ("m", 2, 1, -1.0)], S)).first()
    assert (c.n, c.bad_numbers, c.negative, c.diagonal, c.asymmetric, c.missing) == (3, 1, 1, 1, 1, 4)
    for bad in ([("m", 0, 1, 1.0), ("m", 1, 0, 2.0)], [("m", 0, 1, -1.0)], [("m", 0, 1, 1.0), ("m", 1, 2, 1.0)]):
        with pytest.raises(Exception, match="holds no distance matrix"):
            dg.matrix_diagrams(spark.createDataFrame(bad, S)).collect()


def test_lenses(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for p, want in ((1.0, d.mean(axis=1)), (2.0, np.sqrt((d**2).mean(axis=1))), (math.inf, d.max(axis=1))):
        got = {r.id: r.v[0] for r in mp.eccentricity_lens(df, p, block=7).collect()}
        assert np.allclose([got[i] for i in range(30)], want)
    assert np.allclose([r.v for r in mp.row_lens(df, lambda v: (v.sum(), v[0])).orderBy("id").collect()], np.c_[x.sum(axis=1), x[:, 0]])
    assert np.allclose([r.v[0] for r in mp.resolve_lens(df, "coord2").orderBy("id").collect()], x[:, 2])
    assert mp.resolve_lens(df, lambda t: t.select("id", F.array(F.col("x")[0]).alias("v"))).count() == 30
    with pytest.raises(ValueError):
        mp.resolve_lens(df, "tsne9")
    assert abs(mp.quantile_distance(df, 50) - np.median(d[np.triu_indices(30, 1)])) < 1e-12
    how = mp.calibrate(df, "dbscan", {"eps": ("quantile", 10), "min_samples": 3})
    assert abs(how["eps"] - np.quantile(d[np.triu_indices(30, 1)], 0.1)) < 1e-12 and how["min_samples"] == 3
    with pytest.raises(ValueError):
        mp.calibrate(df, "dbscan", {"eps": "knee"})


def test_mapper_grid(spark, tmp_path):
    a = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    df = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(a)], "id long, x array<double>")
    grid = pg.MapperGrid({"circle": df}, {"lens": ["coord0", "coord9"], "n_intervals": [4, 6], "overlap": 0.3, "clusterer": "single", "cut": 0.2})
    rows = {r.ordinal: r for r in grid.run(spark).collect()}
    assert [rows[k].status for k in range(4)] == ["ok", "ok", "rejected", "rejected"] and "features" in rows[2].error
    assert rows[0].b1 == rows[1].b1 == 1 and rows[0].nerve_b1 == 0 and rows[0].b1_excess == 1 and rows[0].covered == 1.0 and rows[1].n_cells == 6
    nodes, covers, _ = grid.graphs()
    alone = mp.cluster_cells(df, mp.cover(mp.resolve_lens(df, "coord0"), [4], 0.3), "single", cut=0.2)
    h = rows[0].hash
    assert sorted(map(tuple, nodes.filter(F.col("hash") == h).drop("hash").collect())) == sorted(map(tuple, alone.collect()))
    assert {r.status for r in grid.run(spark, {h}).collect()} == {"ok", "done", "rejected"}
    pg.save_graphs(nodes, covers, str(tmp_path / "g"))
    members, edges = pg.load_graph(spark, str(tmp_path / "g"), h)
    assert members.count() == alone.count() and edges.count() == rows[0].n_edges and pg.stored_nerve(spark, str(tmp_path / "g"), h).first()["nodes"] == 4
    for config, why in (({"clusterer": "ward", "cut": 1, "metric": "cosine"}, "Euclidean"), ({"preprocess": "l2", "metric": "cosine", "eps": 1}, "twice"), ({"overlap": 1.5, "eps": 1}, "outside"), ({"n_intervals": 0, "eps": 1}, "at least"), ({"lens": "x", "eps": 1}, "unknown lens"), ({"clusterer": "single"}, "needs cut")):
        assert why in pg.validate(config)
    full = gr.measure(alone, mp.cover(mp.resolve_lens(df, "coord0"), [4], 0.3), 80, 4, tuple(gr.MEASURES)).first()
    assert full.diameter == full.n_nodes // 2 and full.mean_clustering == 0


def test_callables(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, x array<double>")
    cells = df.select("id", F.lit("0").alias("cell"))
    nodes = mp.cluster_cells(df, cells, lambda x, at: (x[:, 0] > at).astype(int), at=3.5)
    assert {(r.label, r.n) for r in nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 4), (1, 6)}
    assert {r.label: r.colour for r in gr.node_colour(nodes, lambda ids: ids.max()).collect()} == {0: 3.0, 1: 9.0}
    e = spark.createDataFrame([("g", "a", "b", 2.0)], "bundle string, u string, v string, w double")
    assert {r.node: r.features for r in wt.node_features(e, lambda m: m.sum(axis=1)).collect()} == {"a": [2.0], "b": [2.0]}
    grid = pg.MapperGrid({"line": df}, {"lens": "coord0", "n_intervals": 2, "clusterer": "single", "cut": 1.5}, ("size",), {"largest_id": lambda n: n.groupBy("hash").agg(F.max("id").cast("double").alias("value"))})
    row = grid.run(spark).first()
    assert row.largest_id == 9.0 and row.n_nodes == 2
    bad = gr.check_graph(spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b")], "bundle string, node string"), spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "a", 1.0), ("g", "a", "a", None), ("g", "a", "z", float("nan"))], "bundle string, u string, v string, w double")).first()
    assert (bad.n, bad.repeated, bad.loops, bad.dangling, bad.bad_weights, bad.twice) == (2, 1, 1, 1, 2, 1)


def test_populations_are_stored_by_layer(spark, tmp_path):
    from strataloom.sources import store

    members = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "member_id string, seed long, trained boolean")
    w = spark.createDataFrame([(m, k, 0, 0, 1.0) for m in "ab" for k in (0, 1)], "member_id string, " + W)
    store.save_population(members, w, str(tmp_path / "p"))
    m, got = store.load_population(spark, str(tmp_path / "p"), [1], True)
    assert m.count() == 1 and [(r.member_id, r.layer_idx) for r in got.collect()] == [("a", 1)]
    assert store.load_population(spark, str(tmp_path / "p"))[1].count() == 4


def test_rolling_snapshots_stream(spark, tmp_path):
    from strataloom.streaming import incremental as inc

    rows = [(s, c, float(s * (c + 1))) for s in range(12) for c in range(2)]
    spark.createDataFrame(rows, "step long, coord int, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("step long, coord int, v double").parquet(str(tmp_path / "in"))
    run = inc.rolling_snapshots(stream, 4, 2).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.win, r.coord): (r.n, r["mean"]) for r in spark.table("rolled").filter("n = 4").collect()}
    assert got == {(w, c): (4, np.mean([s * (c + 1) for s in range(w, w + 4)])) for w in range(0, 9, 2) for c in range(2)}
