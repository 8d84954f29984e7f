import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import kernels as k
from strataloom.operators import diagrams as dg, mapper as mp, points as pt, series as se, uncertainty as un, weights as wt
from strataloom.plans import sweep as sw
from strataloom.sources import store
from strataloom.streaming import incremental

SF = "/root/testdata/sf0.01"


def _circle(n, r, seed, noise=0.02):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return np.c_[np.cos(t), np.sin(t)] * r + np.random.default_rng(seed).normal(0, noise, (n, 2))


def test_circle_has_one_loop_and_two_circles_two():
    x = _circle(24, 1.0, 0)
    loops = [e - b for q, b, e in k.rips(k.distance_block(x, x), 1) if q == 1]
    assert sum(v > 0.5 for v in loops) == 1
    x = np.r_[_circle(16, 0.5, 1), _circle(24, 2.0, 2)]
    assert sum(e - b > 0.3 for q, b, e in k.rips(k.distance_block(x, x), 1) if q == 1) == 2


@pytest.mark.parametrize("coeff", [2, 3])
def test_bars_match_ranks_of_boundary_maps(coeff):
    x = np.random.default_rng(5).normal(size=(9, 2))
    d = k.distance_block(x, x)
    bars = k.rips(d, 1, coeff=coeff)
    for eps in np.quantile(d[d > 0], [0.2, 0.4, 0.6]):
        e = [(i, j) for i in range(9) for j in range(i + 1, 9) if d[i, j] <= eps]
        t = [(a, b, c) for a, b in e for c in range(b + 1, 9) if d[a, c] <= eps and d[b, c] <= eps]
        at = {x: i for i, x in enumerate(e)}
        m1, m2 = np.zeros((9, len(e))), np.zeros((len(e), len(t)))
        for i, (a, b) in enumerate(e):
            m1[a, i], m1[b, i] = -1, 1
        for i, (a, b, c) in enumerate(t):
            m2[at[b, c], i], m2[at[a, c], i], m2[at[a, b], i] = 1, -1, 1
        r1, r2 = np.linalg.matrix_rank(m1), np.linalg.matrix_rank(m2) if t else 0
        assert sum(q == 0 and b <= eps < f for q, b, f in bars) == 9 - r1
        assert sum(q == 1 and b <= eps < f for q, b, f in bars) == len(e) - r1 - r2


def test_merge_heights_ignore_point_order():
    x = np.random.default_rng(1).normal(size=(30, 3))
    p = np.random.default_rng(2).permutation(30)
    a, b = (sorted(e for _, _, e in k.rips(k.distance_block(y, y), 0)) for y in (x, x[p]))
    assert np.allclose(a[:-1], b[:-1]) and math.isinf(a[-1])


def test_matching_distances():
    a, b = np.array([[0.0, 2.0], [1.0, 1.5]]), np.array([[0.0, 2.5]])
    assert k.wasserstein(a, a) == 0 and k.bottleneck(a, a) == 0
    assert k.bottleneck(a, b) == pytest.approx(0.5)
    assert k.wasserstein(a, b) == pytest.approx(0.75)
    assert k.hull_area(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])) == 1.0


def test_clusterers():
    x = np.r_[np.zeros((5, 2)), np.ones((5, 2)) * 10] + np.random.default_rng(0).normal(0, 0.1, (10, 2))
    d = k.distance_block(x, x)
    for labels in (k.dbscan(d, 1, 3), k.linkage_labels(d, 2.0), k.linkage_labels(d, 2.0, "ward"), k.linkage_labels(d, relative_gap=0.5), k.linkage_labels(d, 2.0, "complete"), k.linkage_labels(d, 2.0, "average")):
        assert len(set(labels)) == 2 and len(set(labels[:5])) == 1


def test_known_dimension():
    x = np.random.default_rng(0).random((500, 2)) @ np.random.default_rng(1).normal(size=(2, 6))
    assert k.two_nn_dimension(k.distance_block(x, x)) == pytest.approx(2, abs=0.3)


def test_blocks_agree_with_one_block(spark):
    x = np.random.default_rng(3).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    one, many = (sorted(map(tuple, pt.nearest(df, 3, block=b).collect())) for b in (1000, 7))
    assert one == many
    d = k.distance_block(x, x)
    assert {(i, j) for i, j, _ in pt.pairs_within(df, 1.0, block=7).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 1}


def test_cover_is_closed_and_constant_lens_is_one_interval():
    assert mp.intervals(1.0, 1.0, 5, 0.3) == [(0.5, 1.5)]
    iv = mp.intervals(0.0, 10.0, 5, 0.5)
    assert len(iv) == 5 and iv[0] == (-1.0, 3.0)
    assert mp.max_intervals(100, 1, 200, 1, 0.3) == 1


def test_schedule_and_snap(spark):
    s = wt.clique_schedule()
    assert len(s) == 64 and s[0] == 1.0 and s[-1] == 1e-7 and s == sorted(s, reverse=True)
    got = spark.createDataFrame([(0.5,), (0.51,), (-3.0,), (float("inf"),)], "v double").select(dg.nearest_step(F.col("v"), [0.0, 1.0, 4.0]).alias("s"))
    assert [r.s for r in got.collect()] == [0.0, 1.0, 0.0, math.inf]


def test_sweep_resumes_and_records_errors():
    grid = sw.expand_grid({"layer": ["c1", "c2"], "overlap": [0.3, 0.5], "pin": (1, 2)})
    assert [c["layer"] for c in grid] == ["c1", "c1", "c2", "c2"]
    rows = sw.run_sweep(grid, lambda c: {"m": 1 / (c["overlap"] - 0.5)}, lambda c: "bad" if c["layer"] == "c2" and c["overlap"] == 0.3 else None)
    assert sorted(r["status"] for r in rows) == ["error", "error", "ok", "rejected"]
    done = {r["hash"] for r in rows if r["status"] == "ok"}
    assert len(sw.run_sweep(grid, lambda c: {}, done=done)) == 3


def test_partial_means_add_up(spark):
    rows = [(s, 0, p, float(s + p)) for s in range(6) for p in range(3)]
    d = spark.createDataFrame(rows, "sample long, layer_idx int, pos int, v double")
    lab = spark.createDataFrame([(s, s % 2) for s in range(6)], "sample long, label int")
    whole = un.class_means(d, lab)
    parts = un.merge_means(un.class_means(d.filter("sample < 2"), lab), un.class_means(d.filter("sample >= 2"), lab))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert {r["sample"] for r in un.scores(d, lab, whole).collect()} == set(range(6))


def test_streaming_means_match_batch(spark, tmp_path):
    rows = [(0, s % 2, p, float(s)) for s in range(10) for p in range(2)]
    df = spark.createDataFrame(rows, "layer_idx int, label int, pos int, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = incremental.streaming_class_means(store.snapshots(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " ")))
    run = q.writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("means").collect())) == sorted(map(tuple, incremental.streaming_class_means(df).collect()))


def test_store_round_trip(spark, tmp_path):
    at = str(tmp_path / "s")
    store.save(spark.range(3), at, "nodes")
    assert store.load(spark, at, "nodes").count() == 3
    with pytest.raises(ValueError):
        store.load(spark, at, "edges")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    from strataloom.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("two_nn_id", "relevance_edges", "diagram_statistics", "betti0_at_eps", "nerve_betti", "trajectory_smooth", "node_exemplars"):
        a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = [sorted(map(repr, x[cols].astype(object).itertuples(index=False, name=None))) for x in (a, b)]
        assert rows[0] == rows[1], name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_clique_diagram_covers_every_supplier(spark):
    from strataloom.plans.queries import QUERIES, weights

    w = weights(spark, SF).toPandas()
    vertices = {(layer + s, v) for layer, i, j in zip(w.layer_idx, w.i, w.j) for s, v in ((0, i), (1, j))}
    assert sum(layer == 0 for layer, _ in vertices) == 100
    bars = QUERIES["directed_clique_diagram"](spark, SF).toPandas()
    assert bars[bars.dim == 0].n.sum() == len(vertices)  # each vertex starts a component


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_views_cover_every_layer(spark):
    from strataloom.plans.queries import QUERIES, weights

    w = weights(spark, SF).toPandas()
    assert (w.layer_idx == 0).sum() == 700 and (w.layer_idx == 1).sum() == 21  # full matrices
    mats = {q: g.pivot(index="i", columns="j", values="w") for q, g in w.groupby("layer_idx")}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    how = {"gram_view": lambda m: m, "gram_cosine": unit, "gram_correlation": lambda m: unit(m - m.mean(axis=1, keepdims=True))}
    for name, f in how.items():
        got = {(r.layer_idx, r.a, r.b): r.v for r in QUERIES[name](spark, SF).toPandas().itertuples()}
        want = {}
        for q, m in mats.items():
            g = f(m.to_numpy())
            g = g @ g.T
            want |= {(q, a, b): g[x, y] for x, a in enumerate(m.index) for y, b in enumerate(m.index) if a <= b}
        assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in got) < 2e-6, name
    lags = QUERIES["gram_lags"](spark, SF).toPandas()
    assert set(lags[lags.layer_idx == 0].lag) == set(range(100)) and set(lags[lags.layer_idx == 1].lag) == set(range(7))
    flat = {r.layer_idx: (r.dims, r.mix) for r in QUERIES["flat_view"](spark, SF).toPandas().itertuples()}
    for q, m in mats.items():
        x = m.to_numpy().reshape(-1)
        assert flat[q][0] == len(x) and flat[q][1] == pytest.approx((x * np.arange(1, len(x) + 1)).sum(), abs=1e-4)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
