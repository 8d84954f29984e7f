"""Embeddings: kernels against direct sums, neighbours kept above stated levels, the same result in two runs."""

import numpy as np
import pytest

from strataloom.functions import layout as lo
from strataloom.functions.kernels import distance_block
from strataloom.operators import embed as em, mapper as mp


@pytest.fixture(scope="module")
def sheet(spark):
    """A bent sheet in ten dimensions, and three clusters far off."""
    r = np.random.default_rng(5)
    uv = r.uniform(size=(240, 2))
    x = np.c_[np.sin(2 * uv[:, 0]), np.cos(2 * uv[:, 0]), uv[:, 1], np.zeros((240, 7))]
    x = np.concatenate([x, *(r.normal(scale=0.05, size=(30, 10)) + 5 * c for c in np.eye(10)[3:6])])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3).cache()


def _xy(df):
    return {r.id: tuple(r.v) for r in df.collect()}


def test_bandwidths_meet_their_targets():
    d = np.sort(np.random.default_rng(0).gamma(2.0, size=(50, 30)), axis=1)
    assert np.allclose(lo.fuzzy_weights(d).sum(axis=1), np.log2(30), atol=1e-5)
    p = lo.perplexity_weights(d, 10.0)
    assert np.allclose(np.exp(-(p * np.log(p)).sum(axis=1)), 10, atol=1e-6) and np.allclose(p.sum(axis=1), 1)
    assert np.isfinite(lo.fuzzy_weights(np.zeros((2, 5)))).all() and np.isfinite(lo.perplexity_weights(np.zeros((2, 5)), 3.0)).all()


@pytest.mark.parametrize("scale", [1e-4, 1.0, 12.0])
def test_repulsion_on_the_grid_is_that_of_the_pairs(scale):
    y = np.random.default_rng(1).normal(scale=scale, size=(300, 2))
    force, z = lo.grid_repulsion(y)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    want = (d * (q**2)[:, :, None]).sum(axis=1)
    assert np.linalg.norm(force - want) <= 0.02 * np.linalg.norm(want) and abs(z - (q.sum() - 300)) <= 0.01 * q.sum()


def _kept(x, y, k=10):
    """Share of neighbours kept, without Spark."""
    near = [np.argsort(distance_block(z, z) + 1e9 * np.eye(len(z)), axis=1)[:, :k] for z in (x, y)]
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(*near)])


def _edges(x, k, weigh):
    d = distance_block(x, x) + 1e9 * np.eye(len(x))
    j = np.argsort(d, axis=1)[:, :k]
    w = np.zeros_like(d)
    np.put_along_axis(w, j, weigh(np.take_along_axis(d, j, axis=1)), axis=1)
    return w


def test_layouts_of_one_part_keep_neighbours(sheet):
    x = np.array([r.x for r in sheet.orderBy("id").collect()])
    start = x[:, [0, 2]] - x[:, [0, 2]].mean(axis=0) + 0.1 * x[:, 3:5]
    w = _edges(x, 14, lo.fuzzy_weights)
    w = w + w.T - w * w.T
    head, tail = np.nonzero(w)
    y = lo.attract_epochs(start, np.zeros((0, 2)), head, tail, w[head, tail] / w.max(), np.linspace(1, 0.01, 150), np.random.default_rng(0))
    assert _kept(x, y) >= 0.45
    p = _edges(x, 60, lambda d: lo.perplexity_weights(d, 20.0))
    p = (p + p.T) / 2 / len(x)
    head, tail = np.nonzero(p)
    y = 1e-4 * start
    for rounds, more, momentum in ((100, 12.0, 0.5), (300, 1.0, 0.8)):
        y = lo.neighbour_epochs(y, np.zeros((0, 2)), head, tail, p[head, tail], 1.0, rounds, more, 50.0, momentum)
    assert _kept(x, y) >= 0.6


@pytest.mark.parametrize(("embed", "level"), [(lambda p: em.umap(p, part=150, rounds=3, epochs=60, spectral_rounds=3), 0.25), (lambda p: em.tsne(p, 20.0, part=150, rounds=4, steps=100), 0.3)])
def test_layouts_of_several_parts_keep_neighbours_and_agree(sheet, embed, level):
    a, b = _xy(embed(sheet)), _xy(embed(sheet.repartition(2)))
    assert a == b and len(a) == 330
    x = np.array([r.x for r in sheet.orderBy("id").collect()])
    assert _kept(x, np.array([a[i] for i in range(330)])) >= level


def test_neighbours_kept_counts(spark, sheet):
    same = sheet.select("id", sheet.x.alias("v"))
    assert em.neighbours_kept(sheet, same, 5).first().kept == 1


def test_scaling_finds_flat_distances(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 2))
    points = spark.createDataFrame([(i, [*v.tolist(), 0.0]) for i, v in enumerate(x)], "id long, x array<double>")
    for landmarks in (80, 10):  # all points, or few that fix the plane
        y = _xy(em.landmark_mds(points, 2, landmarks))
        y = np.array([y[i] for i in range(80)])
        assert np.allclose(distance_block(y, y), distance_block(x, x), atol=1e-8)
    d = distance_block(x, x)
    entries = spark.createDataFrame([(b, i, j, float(d[i, j])) for b in ("a", "b") for i in range(20) for j in range(i + 1, 20)], "bundle string, i long, j long, d double")
    got = em.node_positions(entries).collect()
    assert len(got) == 40 and max(r.stress for r in got) < 1e-9
    rough = [[0, 1, 1, 1], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 0]]  # four equal distances don't fit a plane
    s = lo.stress_scaling(np.array(rough, float), 2)[1]
    assert 0 < s < 0.05


def test_few_points_and_names(spark):
    for n in (0, 1, 2, 4):
        points = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(n)], "id long, x array<double>")
        for f in (em.umap, em.tsne, em.landmark_mds):
            got = f(points).collect()
            assert len(got) == n and all(np.isfinite(r.v).all() and len(r.v) == 2 for r in got)
    assert len(mp.resolve_lens(points, "mds1").first().v) == 1
    with pytest.raises(ValueError, match="two dimensions"):
        mp.resolve_lens(points, "tsne3")


def test_rounds_let_go_of_their_exchange(spark, monkeypatch):
    """After every round of a layout the shuffle files of the one before may go."""
    calls = []
    keep = em.released
    monkeypatch.setattr(em, "released", lambda s: (calls.append(1), keep(s)))
    x = np.random.default_rng(1).normal(size=(40, 3))
    cloud = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    assert em.tsne(cloud, perplexity=5.0, rounds=3, steps=2).count() == 40
    assert len(calls) >= 3
