"""Distances between Mapper graphs by optimal transport; a pair of graphs is a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import transport as tr


def _hypergraph(m: np.ndarray, n: np.ndarray, how: str, mass: str) -> tuple[np.ndarray, np.ndarray]:
    size = n @ m.astype(float) if mass == "cluster_size" else np.ones(m.shape[1])
    return tr.node_distances(m, n, how), size / size.sum()


def _graph(m: np.ndarray, n: np.ndarray, structure: str) -> tuple[np.ndarray, np.ndarray]:
    shared = tr.shared_members(m, n)
    np.fill_diagonal(shared, 0)
    c = tr.shortest_paths(np.where(shared > 0, shared, np.inf)) if structure == "shortest_path" else shared
    return c, np.full(len(c), 1 / len(c))


def distances(members: DataFrame, pairs: DataFrame, method: str = "hypernetwork", how: str = "jaccard", mass: str = "cluster_size", structure: str = "shortest_path", restarts: int = 1, seed: int = 0) -> DataFrame:
    """(a, b, distance) for pairs (a, b) of Mapper graphs with members (graph, node, id).

    hypernetwork: co-optimal transport of the member-node relations; hypergraph: Gromov-Wasserstein on distances of
    member sets, by cluster size; graph: the same on paths or weights of the plain graph, every node alike.
    Each value is that of a local optimum, so an upper bound.
    """
    if method not in ("hypernetwork", "hypergraph", "graph"):
        raise ValueError(f"unknown method {method!r}")

    def run(key, x, y):
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": [key[0].as_py()], "b": [key[1].as_py()], "distance": pa.array([None], pa.float64())})
        (m, c), (n, e) = ((tr.incidence(t["nodes"].to_pylist()), t["n"].to_numpy()) for t in (x.sort_by("name"), y.sort_by("name")))
        if method == "hypernetwork":
            (wa, ra, ca), (wb, rb, cb) = tr.hypernetwork(m, c, how), tr.hypernetwork(n, e, how)
            d = tr.co_transport(wa, wb, (ra, rb), (ca, cb), restarts, seed)
        else:
            (u, p), (v, q) = (_hypergraph(*z, how, mass) if method == "hypergraph" else _graph(*z, structure) for z in ((m, c), (n, e)))
            d = tr.gromov_wasserstein(u, v, p, q)
        return pa.table({"a": [key[0].as_py()], "b": [key[1].as_py()], "distance": pa.array([d], pa.float64())})

    # Members in the same nodes count together before anything is sent to a task.
    own = members.select(F.col("graph").cast("string").alias("graph"), F.col("node").cast("string").alias("node"), "id")
    own = own.groupBy("graph", "id").agg(F.array_sort(F.collect_set("node")).alias("nodes")).groupBy("graph", "nodes").agg(F.count(F.lit(1)).alias("n"))
    want = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))

    def side(by: str, *names: str) -> DataFrame:
        rows = want.join(own, F.col(by) == F.col("graph"))
        return rows.select(F.col("a").alias(names[0]), F.col("b").alias(names[1]), F.array_join("nodes", ",").alias("name"), F.transform("nodes", lambda v: v).alias("nodes"), (F.col("n") + 0).alias("n"))

    return side("a", "a1", "b1").groupBy("a1", "b1").cogroup(side("b", "a2", "b2").groupBy("a2", "b2")).applyInArrow(run, "a string, b string, distance double")
