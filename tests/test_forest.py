"""Spanning forests, components and what rests on them, against one-task code, with rounds forced by a small task size."""

import random

import pytest

from strataloom.functions.kernels import Union
from strataloom.operators import forest as fo, graphs as gr, weights as wt


def _graphs(seed=1):
    r = random.Random(seed)
    rows = []
    for b, n, m in (("dense", 40, 500), ("sparse", 300, 320), ("star", 200, 0), ("path", 150, 0), ("tied", 30, 200), ("tiny", 2, 1)):
        if b == "star":
            rows += [(b, "hub", f"n{i:03}", float(i % 5)) for i in range(n)]
        elif b == "path":
            rows += [(b, f"n{i:03}", f"n{i + 1:03}", float(i)) for i in range(n)]
        else:
            rows += [(b, f"n{r.randrange(n):03}", f"n{r.randrange(n):03}", float(r.randrange(3) if b == "tied" else r.random())) for _ in range(m)]
    return rows + [("loop", "x", "x", 1.0), ("loop", "y", "z", float("nan")), ("twice", "p", "q", 2.0), ("twice", "q", "p", 2.0), ("twice", "p", "q", 2.0)]


def _kruskal(rows, sign):
    out, parts = set(), {}
    for b in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == b]
        at = {x: i for i, x in enumerate(sorted({v for _, p, q, _ in own for v in (p, q)}))}
        u = Union(len(at))
        for w, p, q in sorted((sign * w, p, q) for _, p, q, w in own if w == w):
            if p != q and u.join(at[p], at[q]):
                out.add((b, p, q, sign * w))
        parts |= {(b, x): min(y for y in at if u.find(at[y]) == u.find(i)) for x, i in at.items()}
    return out, parts


@pytest.mark.parametrize("task_edges", [25, 10_000])
@pytest.mark.parametrize("largest", [False, True])
def test_forest_equals_kruskal(spark, task_edges, largest):
    rows = _graphs()
    edges = spark.createDataFrame(rows, "bundle string, u string, v string, w double").repartition(3)
    want, parts = _kruskal(rows, -1 if largest else 1)
    tree, names = fo.spanning_forest(edges, largest, task_edges)
    assert sorted(map(tuple, tree.collect())) == sorted(want)
    got = {(r.bundle, r.node): r["name"] for r in names.collect()}
    assert got.keys() == parts.keys()
    assert len({(k[0], got[k], parts[k]) for k in got}) == len({(k[0], got[k]) for k in got}) == len({(k[0], parts[k]) for k in parts})
    assert all((k[0], v) in got for k, v in got.items())


def test_components_are_named_by_their_least_node(spark):
    rows = _graphs(2)
    edges = spark.createDataFrame(rows, "bundle string, u string, v string, w double")
    want = _kruskal([(b, u, v, 0.0) for b, u, v, _ in rows], 1)[1]
    for size in (20, 10_000):
        assert {(r.bundle, r.node): r.component for r in fo.components(edges, size).collect()} == want


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "bundle string, u long, v long, w double")
    tree, parts = fo.spanning_forest(none)
    assert tree.count() == parts.count() == 0 and wt.superlevel_h0(none).count() == 0 and gr.pathways(none).count() == 0


def test_merges_and_pathways_do_not_depend_on_the_task_size(spark):
    rows = [x for x in _graphs(3) if x[0] != "loop"]
    edges = spark.createDataFrame(rows, "bundle string, u string, v string, w double")
    for f in (wt.superlevel_h0, lambda e, task_edges: gr.pathways(e, 4, task_edges)):
        a, b = (sorted(map(repr, f(edges, task_edges=k).collect())) for k in (30, 10_000))
        assert a == b
    deaths = sorted(r.death for r in wt.superlevel_h0(edges.filter("bundle = 'star'")).collect())
    assert deaths == sorted(4.0 - i % 5 for i in range(200)) + [float("inf")]
