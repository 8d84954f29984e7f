"""Findings of round four: repulsion of all points in t-SNE, loops in bounded memory."""

import threading

import tracemalloc

import numpy as np
import pytest

from strataloom.functions import cohomology as co, layout as lo, mesh, streamed as st
from strataloom.functions.kernels import distance_block, geodesic_distances, hop_matrix, rips
from strataloom.operators import diagrams as dg, embed as em, geodesic as geo


class _Context:
    """A barrier stage of threads."""

    def __init__(self, rank, size, box, wall):
        self.rank, self.size, self.box, self.wall = rank, size, box, wall

    def partitionId(self):
        return self.rank

    def getTaskInfos(self):
        return [type("Info", (), {"address": "127.0.0.1:0"}) for _ in range(self.size)]

    def allGather(self, word):
        self.box[self.rank] = word
        self.wall.wait()
        return [self.box[k] for k in range(self.size)]


def _cloud(n):
    r = np.random.default_rng(3)
    head = np.repeat(np.arange(n), 5)
    tail = r.integers(n, size=len(head))
    return r.normal(scale=3.0, size=(n, 2)), head, tail, np.full(len(head), 1 / len(head))


def _in_tasks(y, head, tail, p, size, rounds):
    box, wall, out, wrong = {}, threading.Barrier(size), lo.fresh(y), []

    def task(rank):
        try:
            peers = mesh.Mesh(_Context(rank, size, box, wall))
            own = np.flatnonzero(np.arange(len(y)) * 7 % 11 % size == rank)
            peers.named(own)
            k = np.isin(head, own)
            out[own] = lo.neighbour_steps(out[own], own, np.searchsorted(own, head[k]), tail[k], p[k], rounds, 1.0, 20.0, 0.5, peers)
            peers.close()
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    tasks = [threading.Thread(target=task, args=(k,)) for k in range(size)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join(60)
    assert not wrong
    return out[:, :2]


def test_every_point_is_pushed_by_all():
    """a step in several tasks is that of the direct sums over all pairs, and the tasks' number changes nothing."""
    for n in (200, 2000):  # pairs, and the grid
        y, head, tail, p = _cloud(n)
        d = y[:, None] - y[None]
        q = 1 / (1 + (d**2).sum(axis=2))
        push = (d * (q**2)[:, :, None]).sum(axis=1) / (q.sum() - n)
        f = (p / (1 + ((y[head] - y[tail]) ** 2).sum(axis=1)))[:, None] * (y[head] - y[tail])
        pull = np.stack([np.bincount(head, f[:, c], n) for c in range(2)], axis=1)
        g = 4 * (pull - push)
        want = y - 20.0 * np.where(g > 0, 1.2, 0.8) * g
        got = _in_tasks(y, head, tail, p, 3, 1)
        assert np.linalg.norm(got - want) <= 0.02 * np.linalg.norm(want - y)
        assert (_in_tasks(y, head, tail, p, 4, 5) == lo.neighbour_epochs(y, np.zeros((0, 2)), head, tail, p, 1.0, 5, 1.0, 20.0, 0.5)).all()


def test_one_task_follows_the_order_of_ids():
    """rows come to a task in any order; edges name their ends by the order of ids."""
    y, head, tail, p = _cloud(50)
    mixed = np.random.default_rng(0).permutation(50)
    place = np.argsort(mixed)
    order = np.argsort(place[head], kind="stable")
    peers = mesh.Alone()
    peers.named(mixed)
    got = lo.neighbour_steps(lo.fresh(y[mixed]), mixed, place[head][order], tail[order], p[order], 3, 1.0, 20.0, 0.5, peers)[:, :2]
    assert (got == lo.neighbour_epochs(y, np.zeros((0, 2)), head, tail, p, 1.0, 3, 1.0, 20.0, 0.5)[mixed]).all()


def test_the_layout_does_not_depend_on_its_parts(spark):
    """parts used to push their own points only, so a layout in parts differed from that of one part."""
    x = np.random.default_rng(1).normal(size=(60, 5))
    cloud = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").cache()
    one, three = ({r.id: tuple(r.v) for r in em.tsne(cloud, 5.0, rounds=2, steps=20, part=part).collect()} for part in (4096, 20))
    assert one == three and len(one) == 60


def _kinds(x):
    d = distance_block(x, x)
    bits = (x > 0).astype(float)
    return {"h1": d, "geodesic": geodesic_distances(d, 3), "polyhedral": distance_block(bits, bits, "hamming")}


@pytest.mark.parametrize("batch", [40, 500, 1 << 20])
def test_loops_of_batches_are_those_of_the_matrix(monkeypatch, batch):
    """the same bars whether edges come in batches or as a matrix of numbers, with many equal lengths too."""
    monkeypatch.setattr(st, "BATCH", batch)
    monkeypatch.setattr(st, "ENTRIES", 1000)
    r = np.random.default_rng(7)
    for dims in (2, 20):
        x = r.normal(size=(90, dims))
        for d in _kinds(x).values():
            assert sorted(st.pairs(st.Rows(lambda i: d[i], len(d)))) == sorted(rips(d, 1))  # noqa: B023
            assert sorted(st.pairs(st.Rows(lambda i: d[i], len(d), 0.8))) == sorted(rips(d, 1, 0.8))  # noqa: B023
        d = _kinds(x)["h1"]
        for eps in (0.5, 2.0):
            u, v, length = co.sparse_edges(d.__getitem__, len(d), eps)
            assert sorted(st.pairs(st.Rows(co.sparse_lengths(d.__getitem__, len(d), eps), len(d)))) == sorted(co.pairs(co.Sparse(u, v, length, len(d))))
    for n in (0, 1, 2):
        assert sorted(st.pairs(st.Rows(lambda i: np.zeros((len(i), n)), n))) == sorted(rips(np.zeros((n, n)), 1) if n else [])  # noqa: B023


def test_hops_in_a_byte():
    """hop distances of parts that don't meet, and of a chain too long for a byte."""
    r = np.random.default_rng(8)
    for x, k in ((np.r_[r.normal(size=(60, 3)), r.normal(size=(40, 3)) + 50], 3), (np.arange(300.0)[:, None] ** 1.01, 1), (np.arange(700.0)[:, None], 2)):
        assert (hop_matrix(x, k) == geodesic_distances(distance_block(x, x), k)).all()


def test_loops_of_large_bundles_go_by_batches(spark, monkeypatch):
    """bundles above KEPT points give the same diagrams without their matrices."""
    x = np.random.default_rng(9).normal(size=(80, 6))
    cloud = spark.createDataFrame([("a" if k % 2 else "b", k, v.tolist()) for k, v in enumerate(x)], "bundle string, id long, x array<double>").cache()
    ways = (lambda: dg.rips_diagrams(cloud, 1), lambda: dg.rips_diagrams(cloud, 1, metric="hamming"), lambda: dg.sparse_diagrams(cloud, 0.5), lambda: geo.diagrams(cloud, [2, 3]))
    want = [sorted(map(tuple, way().collect())) for way in ways]
    monkeypatch.setattr(dg, "KEPT", 10)
    monkeypatch.setattr(geo, "KEPT", 10)
    assert [sorted(map(tuple, way().collect())) for way in ways] == want


def test_loops_take_less_memory_than_the_matrix():
    """1,500 points; a matrix of distances alone would take 18 MB, with its numbers and edges over 60 MB."""
    x = np.random.default_rng(1).normal(size=(1500, 2))
    tracemalloc.start()
    g = st.Rows(lambda i: distance_block(x[i], x), len(x))
    g.step = 50
    batches = 0
    for i, _, _ in g.batches():
        batches = max(batches, len(i))
        break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < batches <= st.BATCH and peak < 60e6
