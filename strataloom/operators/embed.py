"""Embeddings of clouds (id, x) as lenses and pictures: UMAP, t-SNE, multidimensional scaling.

Both layouts go in rounds.  UMAP deals the points to parts by hash, so a part is a fair
sample; in a round each part moves its own points for some epochs, with its neighbours in
other parts as they were, and pushes them from one another, which stand for all points.
Between rounds the parts exchange coordinates.  The tasks of a round of t-SNE exchange the
coordinates in every step, and every point is pushed by all.  No task holds more than its
points' edges and all coordinates, and the result is the same in every run of one seed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import distance_block
from ..functions.layout import attract_epochs, classical_scaling, fresh, fuzzy_weights, neighbour_steps, perplexity_weights, stress_scaling
from ..functions.mesh import Alone, Mesh
from ..sources.scratch import released, written
from . import mapper as mp, points as pt

#: Points of a part.
PART = 4096


def _weighted(near: DataFrame, k: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, j, w): weights of each point's neighbours (i, j, rank, d), from its k distances."""

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            rows = t.column(1).to_pylist()
            d = np.array([[e["d"] for e in r] for r in rows], float)
            j = np.array([[e["j"] for e in r] for r in rows])
            yield pa.record_batch({"i": t.column(0).take(pa.array(np.repeat(np.arange(len(rows)), d.shape[1]))), "j": pa.array(j.reshape(-1)), "w": pa.array(weigh(d).reshape(-1))})

    rows = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d"))).alias("e"))  # k a point
    return rows.mapInArrow(run, "i long, j long, w double")


def _both_ways(edges: DataFrame, combine) -> DataFrame:
    """Every edge in both directions, its weight from those of the two (0 if there is one only)."""
    pair = edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("c"))
    w = combine(F.col("s"), F.when(F.col("c") > 1, F.col("p")).otherwise(0.0))
    one = pair.select("a", "b", w.alias("w"))
    return one.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(one.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))


def fuzzy_graph(points: DataFrame, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """(i, j, w), both ways: memberships of the k - 1 nearest others, joined as a + b - ab."""
    return _both_ways(_weighted(pt.nearest(points, k - 1, metric), k - 1, fuzzy_weights), lambda s, p: s - p)


def _moments(x: DataFrame, dims: int) -> np.ndarray:
    """Sums of products of the columns d, v0, v1 ... of x: one row."""
    names = ["d", *[f"v{c}" for c in range(dims)]]
    row = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names]).first()
    return np.array([[row[f"{a}_{b}"] or 0.0 for b in names] for a in names])


def spectral_start(edges: DataFrame, start: DataFrame, dims: int, rounds: int = 8) -> DataFrame:
    """(id, v): leading eigenvectors of the normalised graph (i, j, w) by subspace iteration from a start (id, v); each round is a join and a sum.

    The trivial eigenvector, the roots of the degrees, is taken out in every round.
    """
    degree = edges.groupBy("i").agg(F.sqrt(F.sum("w")).alias("d"))
    e = written(edges.join(degree.select("i", F.col("d").alias("di")), "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", (F.col("w") / F.col("di") / F.col("dj")).alias("w")), "graph")
    vs = [f"v{c}" for c in range(dims)]
    x = start.join(degree.withColumnRenamed("i", "id"), "id").select("id", "d", *[F.col("v")[c].alias(f"v{c}") for c in range(dims)])
    for _ in range(rounds):
        x = written(x, "start")
        g = _moments(x, dims)
        out = g[0, 1:] / max(g[0, 0], 1e-300)
        inner = g[1:, 1:] - np.outer(out, g[0, 1:])  # after the trivial one is taken out
        turn = np.linalg.inv(np.linalg.cholesky(inner + 1e-12 * np.trace(inner) * np.eye(dims) + 1e-300 * np.eye(dims))).T
        clean = [F.col(v) - float(o) * F.col("d") for v, o in zip(vs, out)]
        x = x.select("id", "d", *[sum((c * float(t) for c, t in zip(clean, turn[:, k])), F.lit(0.0)).alias(vs[k]) for k in range(dims)])
        moved = e.join(x.select(F.col("id").alias("j"), *vs), "j").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(v)).alias(f"_{v}") for v in vs])
        x = x.join(moved, "id").select("id", "d", *[((F.col(v) + F.col(f"_{v}")) / 2).alias(v) for v in vs])
    return x.select("id", F.array(*[F.col(v) / F.col("d") for v in vs]).alias("v"))


def _scaled(x: DataFrame, dims: int, size: float, by_spread: bool) -> DataFrame:
    """Coordinates about their mean, with the largest magnitude (or the first axis' deviation) given.

    Rounded to a ten millionth of that: sums in Spark differ in their last digits from run to run, and a layout would amplify it.
    """
    v = [F.col("v")[c] for c in range(dims)]
    row = x.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(v)], F.stddev_pop(v[0]).alias("s"), F.max(F.greatest(*[F.abs(c) for c in v], F.lit(0.0))).alias("top")).first()
    unit = (row["s"] if by_spread else row["top"]) or 1.0
    return x.select("id", F.array(*[F.round((c - (row[f"m{k}"] or 0.0)) / unit, 7) * size for k, c in enumerate(v)]).alias("v"))


def _move(step: Callable, k: int) -> Callable:
    """The k-th round of a part: a function of its key, its points and its edges with the coordinates at their other ends."""

    def run(key, own, edge):
        own = own.sort_by("id")
        if not own.num_rows:
            return own.select(["id", "v"])
        edge = edge.sort_by([("i", "ascending"), ("j", "ascending")])
        ids, x = own["id"].to_numpy(), np.array(own["v"].to_pylist(), float)
        head, j = np.searchsorted(ids, edge["i"].to_numpy()), edge["j"].to_numpy()
        at = np.minimum(np.searchsorted(ids, j), len(ids) - 1)
        inside = ids[at] == j
        others, first = np.unique(j[~inside], return_index=True)
        far = np.array(edge["vj"].to_pylist(), float).reshape(-1, x.shape[1])[~inside][first]
        tail = np.where(inside, at, len(ids) + np.searchsorted(others, j))
        out = step(k, key[0].as_py(), x, far, head, tail, edge["w"].to_numpy())
        return pa.table({"id": own["id"], "v": pa.array(out.tolist(), pa.list_(pa.float64()))})

    return run


def _layout(edges: DataFrame, start: DataFrame, part: int, rounds: int, step: Callable[[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """start (id, v) after some rounds of step(round, part number, own, outside, head, tail, w)."""
    parts = max(1, -(-start.count() // part))
    of = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(parts)).cast("int")
    e = written(edges.withColumn("part", F.pmod(F.xxhash64("i", F.lit(17)), F.lit(parts)).cast("int")), "edges")
    now = written(start, "layout")
    for k in range(rounds):
        met = e.join(now.select(F.col("id").alias("j"), F.col("v").alias("vj")), "j")
        now = written(now.withColumn("part", of).groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_move(step, k), "id long, v array<double>"), "layout")
        del met
        released(now.sparkSession)  # a round's exchange is several times the edges
    return now


def umap(points: DataFrame, dims: int = 2, k: int = 15, metric: str = "euclidean", seed: int = 0, rounds: int = 8, epochs: int = 25, part: int = PART, spectral_rounds: int = 8) -> DataFrame:
    """(id, v) of a cloud (id, x): a layout of its fuzzy neighbour graph.

    rounds * epochs epochs at a falling rate, from a spectral start.  Fewer than three points stand at the origin.
    """
    n = points.count()
    if n < 3:
        return points.select("id", F.array(*[F.lit(0.0)] * dims).alias("v"))
    graph = written(fuzzy_graph(points, min(k, n), metric), "fuzzy")
    first = mp.pca_lens(points, dims) if dims <= len(points.first()["x"]) else points.select("id", F.array(*[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10**6)) / 10.0**6).alias("v") for c in range(dims)]).alias("v"))
    start = _scaled(spectral_start(graph, first, dims, spectral_rounds), dims, 10.0, False)
    top = graph.agg(F.max("w")).first()[0] or 1.0

    def step(r, p, x, far, head, tail, w):
        rng = np.random.default_rng([seed, r, p])
        rates = 1 - (r * epochs + np.arange(epochs)) / (rounds * epochs)
        x = x + rng.normal(scale=1e-4, size=x.shape) if r == 0 else x  # copies part
        return attract_epochs(x, far, head, tail, w / top, rates, rng)

    return _layout(graph, start, part, rounds, step)


def _together(step: Callable) -> Callable:
    """A round of steps that all tasks of a stage take together: rows (id, s, j, w) of points with their state and edges to (id, s) after it."""

    def run(batches):
        from pyspark import BarrierTaskContext

        ids, states, sizes, js, ws = [np.zeros(0, np.int64)], [np.zeros((0, 6))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for t in batches:
            ids.append(t.column(0).to_numpy())
            states.append(t.column(1).flatten().to_numpy().reshape(-1, 6))
            sizes.append(np.diff(t.column(2).offsets.to_numpy()))
            js.append(t.column(2).flatten().to_numpy())
            ws.append(t.column(3).flatten().to_numpy())
        ids, state, size, j, w = (np.concatenate(x) for x in (ids, states, sizes, js, ws))
        context = BarrierTaskContext.get()
        peers = Mesh(context) if len(context.getTaskInfos()) > 1 else Alone()
        try:
            every = peers.named(ids)
            tail = np.searchsorted(every, j).astype(np.int32)
            del j
            state = step(state, np.searchsorted(every, ids), np.repeat(np.arange(len(ids), dtype=np.int32), size), tail, w, peers)
        finally:
            peers.close()
        for s in range(0, len(ids), 65536):
            e = min(s + 65536, len(ids))
            yield pa.record_batch({"id": pa.array(ids[s:e]), "s": pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1, dtype=np.int32) * 6), pa.array(state[s:e].reshape(-1)))})

    return run


def tsne(points: DataFrame, perplexity: float = 30.0, metric: str = "euclidean", seed: int = 0, rounds: int = 10, steps: int = 50, part: int = PART) -> DataFrame:
    """(id, v) of a cloud (id, x) in the plane: a layout whose neighbour probabilities match those of the cloud.

    Attraction goes over three times the perplexity of neighbours, repulsion comes from all points, over a grid.  The
    first quarter of the rounds pulls twelve times as much.  Fewer than three points stand at the origin.
    A round is one stage whose tasks (at most one a core, of at least part points) must all run at once.
    """
    n = points.count()
    if n < 3:
        return points.select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("v"))
    perplexity = min(perplexity, max(1.0, (n - 1) / 3))
    k = min(n - 1, max(1, int(3 * perplexity)))
    graph = _both_ways(_weighted(pt.nearest(points, k, metric), k, lambda d: perplexity_weights(d, perplexity)), lambda s, p: s / (2 * n))
    start = mp.pca_lens(points, min(2, len(points.first()["x"])))
    start = _scaled(start.select("id", F.array(F.col("v")[0], F.coalesce(F.get("v", F.lit(1)), F.lit(0.0))).alias("v")), 2, 1e-4, True)
    near = graph.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("e"))  # a point's neighbours, and those whose neighbour it is
    near = written(near.select(F.col("i").alias("id"), F.col("e.j").alias("j"), F.col("e.w").alias("w")), "edges")
    apart = [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(c)), F.lit(2**20)) / 2.0**20 - 0.5) * 1e-6 for c in range(2)]  # copies part
    now = written(start.select("id", F.array(*[F.col("v")[c] + a for c, a in enumerate(apart)], *[F.lit(x) for x in fresh(np.zeros((1, 2)))[0, 2:].tolist()]).alias("s")), "layout")
    spark = now.sparkSession
    slots = spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1"))
    tasks = max(1, min(-(-n // part), slots))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    for r in range(rounds):
        early = r < max(1, rounds // 4)

        def step(state, at, head, tail, w, peers, early=early):
            return neighbour_steps(state, at, head, tail, w, steps, 12.0 if early else 1.0, max(n / 48, 50.0), 0.5 if early else 0.8, peers)

        met = now.join(near, "id", "left").select("id", "s", F.coalesce("j", none("bigint")).alias("j"), F.coalesce("w", none("double")).alias("w"))
        now = written(met.repartition(tasks).mapInArrow(_together(step), "id long, s array<double>", barrier=True), "layout")
        del met
        released(spark)  # a round's exchange is as large as the edges
    return now.select("id", F.slice("s", 1, 2).alias("v"))


def landmark_mds(points: DataFrame, dims: int = 2, landmarks: int = 500, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """(id, v) of a cloud (id, x): classical scaling of at most so many landmarks (the least hashes of the ids), every point placed by its distances to them.

    With no more points than landmarks it is the classical scaling of all.
    """
    some = np.array([r["x"] for r in points.select("id", "x").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(landmarks).collect()], float)  # a stated number of rows
    if not len(some):
        return points.select("id", F.array(*[F.lit(0.0)] * dims).alias("v"))
    d = distance_block(some, some, metric)
    x, values = classical_scaling(d, dims)
    mean = (d * d).mean(axis=0)
    back = np.where(values > 1e-12 * max(values.max(initial=0), 1e-300), x / np.where(values > 0, values, 1), 0)

    def place(batches):
        for t in batches:
            if t.num_rows:
                s = distance_block(np.stack(t.column(1).to_numpy(zero_copy_only=False)).astype(float), some, metric) ** 2
                yield pa.record_batch({"id": t.column(0), "v": pa.array((-(s - mean) @ back / 2).tolist(), pa.list_(pa.float64()))})

    return points.select("id", "x").mapInArrow(place, "id long, v array<double>")


def node_positions(entries: DataFrame, kind: str = "distance", dims: int = 2) -> DataFrame:
    """(bundle, i, v, stress): positions of least stress of the nodes of matrices (bundle, i, j, d), a bundle a task.

    kind: distance; similarity (the largest less the entry) or adjacency (1 less the entry).
    Entries stand in either half; absent ones are 0.  stress: squared errors over squared distances.
    """
    if kind not in ("distance", "similarity", "adjacency"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(key, t):
        i, j, d = (t[c].to_numpy() for c in ("i", "j", "d"))
        names = np.unique(np.r_[i, j])
        m = np.zeros((len(names), len(names)))
        a, b = np.searchsorted(names, i), np.searchsorted(names, j)
        np.maximum.at(m, (a, b), d)
        m = np.maximum(m, m.T)
        m = m if kind == "distance" else (m.max() if kind == "similarity" else 1.0) - m
        np.fill_diagonal(m, 0)
        x, stress = stress_scaling(m, dims)
        return pa.table({"bundle": pa.array([key[0].as_py()] * len(names), pa.string()), "i": pa.array(names, pa.int64()), "v": pa.array(x.tolist(), pa.list_(pa.float64())), "stress": pa.array([stress] * len(names))})

    own = entries.select(F.col("bundle").cast("string").alias("bundle"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
    return own.groupBy("bundle").applyInArrow(run, "bundle string, i long, v array<double>, stress double")


def neighbours_kept(points: DataFrame, embedding: DataFrame, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """One row (kept): the mean share of a point's k nearest in the cloud that are among its k nearest in the embedding (id, v)."""
    a = pt.nearest(points, k, metric).select("i", "j")
    b = pt.nearest(embedding.select("id", F.col("v").alias("x")), k).select("i", "j")
    both = a.join(b, ["i", "j"]).agg(F.count(F.lit(1)).alias("c"))
    return both.join(F.broadcast(a.agg(F.count(F.lit(1)).alias("n")))).select((F.col("c") / F.col("n")).alias("kept"))  # one row each
