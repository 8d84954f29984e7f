"""Loops over Z/2 by the classes of edges against columns over Z/3, on the kinds of distances that the queries have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import cohomology as co
from strataloom.functions.kernels import distance_block, geodesic_distances
from strataloom.operators import diagrams as dg


class Counted(co.Dense):
    """Notes the edges that were looked at."""

    def before(self, e):
        self.seen = getattr(self, "seen", 0) + 1
        return super().before(e)


def _same(d):
    g = Counted(d, float(d.max(axis=1).min()))
    bars = co.pairs(g)
    assert sorted(bars) == sorted(co.pairs(g, True, 3)) and any(k for k, _, _ in bars)
    return g


def test_loops_of_hop_distances():
    """Many equal lengths; four bytes a pair."""
    x = np.random.default_rng(2).normal(size=(120, 20))
    g = _same(geodesic_distances(distance_block(x, x), 3))
    assert g.rank.itemsize == 4 and 0 < g.seen <= g.none


def test_loops_of_a_sparse_filtration_with_most_pairs():
    """In many dimensions a sparse filtration keeps most pairs: it is worked as a matrix of numbers, with the same bars as a list of edges."""
    x = np.random.default_rng(3).normal(size=(90, 64))
    u, v, length = co.sparse_edges(lambda i: distance_block(x[i : i + 1], x)[0], len(x), 0.5)
    g = co.Sparse(u, v, length, len(x))
    assert g.none * 16 >= g.n**2
    assert sorted(co.pairs(g)) == sorted(co.pairs(co.Dense.of(g))) == sorted(co.pairs(g, True, 3))


def test_loops_of_linear_regions():
    """Shares of differing signs: few distinct lengths; the work ends with the last loop."""
    x = (np.random.default_rng(4).normal(size=(160, 64)) > 0).astype(float)
    g = _same(distance_block(x, x, "hamming"))
    assert g.seen < g.none / 2


def _tasks(spark, of):
    """Tasks that got bars of each of eight clouds, whose small partitions Spark would join."""
    r = np.random.default_rng(5)
    rows = [(f"b{b}", k, (r.normal(size=4) > 0).astype(float).tolist()) for b in range(8) for k in range(40)]
    points = spark.createDataFrame(rows, "bundle string, id long, x array<double>")
    bars = of(points).withColumn("task", F.spark_partition_id())
    return {x.bundle: x.tasks for x in bars.groupBy("bundle").agg(F.collect_set("task").alias("tasks")).collect()}


@pytest.mark.parametrize("of", [lambda t: dg.rips_diagrams(t, 1, metric="hamming"), lambda t: dg.sparse_diagrams(t, 0.5)], ids=["rips", "sparse"])
def test_each_cloud_with_loops_has_a_task_of_its_own(spark, of):
    tasks = _tasks(spark, of)
    assert len(tasks) == 8 and all(len(t) == 1 for t in tasks.values()) and len({t[0] for t in tasks.values()}) == 8


def test_sets_of_loops_that_end_are_few():
    """Sets that came to nothing go, and what is kept of a loop goes with it."""
    x = np.random.default_rng(6).normal(size=(150, 64))
    d = distance_block(x, x)
    g = co.Dense(d, float(d.max(axis=1).min()))
    held = []

    class Noted(co._Classes):
        def __init__(self):
            super().__init__()
            self.most = 64
            held.append(self)

        def _end(self, last, v):
            super()._end(last, v)
            assert last not in self.holders

        def _tidy(self, row):
            super()._tidy(row)
            assert row.max() < len(self.sets) and all(self.sets[1:])
            assert {k: {i for i, s in enumerate(self.sets) if k in s} for k in self.holders} == self.holders
            self.most = 64 + len(self.sets)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(co, "_Classes", Noted)
        bars = co.pairs(g)
    assert held and not held[0].holders and sorted(bars) == sorted(co.pairs(g, True, 3))


@pytest.mark.parametrize("near", [1, 3, 24])
def test_last_edge_without_a_nearer_vertex(monkeypatch, near):
    monkeypatch.setattr(co, "NEAR", near)
    r = np.random.default_rng(7)
    for x in (r.normal(size=(60, 3)), r.normal(size=(60, 40)), np.round(r.normal(size=(40, 2)), 1), np.c_[np.cos(np.arange(30)), np.sin(np.arange(30))]):
        d = distance_block(x, x)
        g = co.Dense(d, float(d.max(axis=1).min()))
        gaps = [e for e in range(g.none) if not len(g.before(e)[0])]
        for e in (0, gaps[-1], gaps[-1] + 1, g.none // 2):
            assert g.last_gap(e) == max((f for f in gaps if f >= e), default=-1)
