"""Graphs as tables of nodes and edges: degree features, pathways, measures of Mapper graphs, colours of their nodes."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import Union
from ..sources.scratch import written
from . import mapper as mp
from .forest import TASK_EDGES, components, spanning_forest

#: Measures by what they describe.
MEASURES = {
    "size": ("n_nodes", "n_edges", "membership", "node_mean", "node_median", "node_max", "node_min"),
    "cover": ("n_cells", "n_nonempty", "empty_frac", "node_ratio", "mean_cells_per_point", "covered", "cell_size_median", "cell_size_max", "skipped_cells"),
    "lattice": ("cpc_mean", "cpc_frac_1", "cpc_max"),
    "topology": ("b0", "b1", "nerve_V", "nerve_E", "nerve_b0", "nerve_b1", "b1_excess"),
    "shape": ("mean_degree", "max_degree", "branch_points", "leaves", "isolated", "n_components", "largest_component"),
    "expensive": ("density", "mean_clustering", "diameter"),
}


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bundle, node, degree, strength) of nodes (bundle, node) under edges (bundle, u, v, w)."""
    ends = edges.select("bundle", F.col("u").alias("node"), "w").unionByName(edges.select("bundle", F.col("v").alias("node"), "w"))
    own = ends.groupBy("bundle", "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    return nodes.join(own, ["bundle", "node"], "left").na.fill({"degree": 0, "strength": 0.0})


def clustering(edges: DataFrame) -> DataFrame:
    """(bundle, node, clustering): share of a node's pairs of neighbours that are joined, each triangle by the cube root of its weights over the largest.

    Triangles are found from each edge's end of lower degree, so a hub isn't paired with itself.
    """
    top = edges.groupBy("bundle").agg(F.max(F.abs("w")).alias("_top"))
    e = edges.filter("u <> v").join(top, "bundle").select("bundle", "u", "v", F.cbrt(F.col("w") / F.col("_top")).alias("w"))
    both = e.unionByName(e.select("bundle", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    degree = both.groupBy("bundle", F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    rank = lambda c: degree.select("bundle", F.col("node").alias(c), F.struct("d", F.col("node").alias("n")).alias(f"_{c}"))
    up = both.join(rank("u"), ["bundle", "u"]).join(rank("v"), ["bundle", "v"]).filter("_u < _v").select("bundle", "u", "v", "w", "_v")
    a, b = (up.select("bundle", "u", F.col("v").alias(x), F.col("w").alias(f"w{x}"), F.col("_v").alias(f"r{x}")) for x in ("x", "y"))
    wedge = a.join(b, ["bundle", "u"]).filter("rx < ry")
    tri = wedge.join(up.select("bundle", F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("wxy")), ["bundle", "x", "y"]).withColumn("t", F.col("wx") * F.col("wy") * F.col("wxy"))
    per = tri.select("bundle", F.explode(F.array("u", "x", "y")).alias("node"), "t").groupBy("bundle", "node").agg(F.sum("t").alias("t"))
    c = F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0.0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return degree.join(per, ["bundle", "node"], "left").select("bundle", "node", c.alias("clustering"))


def _centrality(n: int, near: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Betweenness over weighted shortest paths, and closeness over hops."""
    between, close = np.zeros(n), np.zeros(n)
    for s in range(n):
        dist, paths, before, order = {s: 0.0}, np.zeros(n), [[] for _ in range(n)], []
        paths[s] = 1
        heap, done = [(0.0, s)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            order.append(x)
            for y, w in near[x]:
                new = d + w
                if y not in dist or new < dist[y] - 1e-12:
                    dist[y], paths[y], before[y] = new, paths[x], [x]
                    heapq.heappush(heap, (new, y))
                elif abs(new - dist[y]) <= 1e-12 and y not in done:
                    paths[y] += paths[x]
                    before[y].append(x)
        share = np.zeros(n)
        for y in reversed(order):
            for x in before[y]:
                share[x] += paths[x] / paths[y] * (1 + share[y])
            if y != s:
                between[y] += share[y]
        level, hops, seen = [s], 0, {s}
        total = 0
        while level:
            hops += 1
            level = [y for y in {y for x in level for y, _ in near[x]} if y not in seen]
            seen.update(level)
            total += hops * len(level)
        if total and n > 1:
            close[s] = (len(seen) - 1) / total * (len(seen) - 1) / (n - 1)
    return between / ((n - 1) * (n - 2) if n > 2 else 1), close


def centrality(edges: DataFrame) -> DataFrame:
    """(bundle, node, betweenness, closeness): share of the weighted shortest paths through a node, and closeness in hops scaled by the part of the graph it reaches.

    Every node is a source, so a graph takes nodes times edges in one task; graphs run side by side.
    """

    def run(key, t):
        u, v, w = (t[c].to_pylist() for c in ("u", "v", "w"))
        names = sorted({*u, *v})
        at = {x: i for i, x in enumerate(names)}
        near: list[list] = [[] for _ in names]
        for a, b, x in zip(u, v, w):
            if a != b:
                near[at[a]].append((at[b], x))
                near[at[b]].append((at[a], x))
        between, close = _centrality(len(names), near)
        return pa.table({"bundle": pa.array([key[0].as_py()] * len(names)), "node": pa.array(names), "betweenness": pa.array(between), "closeness": pa.array(close)})

    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("bundle", "u")}
    return edges.groupBy("bundle").applyInArrow(run, f"bundle {kinds['bundle']}, node {kinds['u']}, betweenness double, closeness double")


def pathways(edges: DataFrame, n: int = 6, task_edges: int = TASK_EDGES) -> DataFrame:
    """(bundle, u, v, w, role, cluster): the edges of the maximum spanning forest of graphs (bundle, u, v, w) by |w|.

    role is death for the n - 1 weakest, which cut the forest into the most persistent
    clusters, else tree, with the number of its cluster in the order of their least nodes.
    A graph's clusters are numbered in one window, a row for each.
    """
    own = edges.select(F.col("bundle").cast("string").alias("bundle"), "u", "v", F.abs("w").cast("double").alias("w"))
    tree, parts = spanning_forest(own, largest=True, task_edges=task_edges)
    tree = written(tree, "tree")
    weak = tree.withColumn("_k", F.row_number().over(Window.partitionBy("bundle").orderBy("w", "u", "v"))).filter(F.col("_k") < n)
    role = written(tree.join(weak.select("bundle", "u", "v", F.lit("death").alias("role")), ["bundle", "u", "v"], "left"), "roles")
    held = components(role.filter("role is null").select("bundle", "u", "v"), task_edges)
    alone = parts.select("bundle", "node").join(held.select("bundle", "node"), ["bundle", "node"], "left_anti").withColumn("component", F.col("node"))
    of = written(held.unionByName(alone), "clusters")
    number = of.filter(F.col("node") == F.col("component")).select("bundle", "component", (F.row_number().over(Window.partitionBy("bundle").orderBy("component")) - 1).alias("cluster"))
    at = of.join(number, ["bundle", "component"]).select("bundle", F.col("node").alias("u"), "cluster")
    out = role.join(at, ["bundle", "u"])
    return out.select("bundle", "u", "v", "w", F.coalesce("role", F.lit("tree")).alias("role"), F.when(F.col("role").isNull(), F.col("cluster")).alias("cluster"))


def measure(nodes: DataFrame, cells: DataFrame, points: int, n_cells: int, groups: tuple[str, ...] = ("size", "cover", "lattice", "topology", "shape"), key: str | None = None) -> DataFrame:
    """The measures of groups for Mapper graphs: memberships (cell, label, id) with the cover (cell, id) they come from.

    key: a column of both tables that tells several graphs apart; a row for each.  points:
    of the cloud; n_cells: of the whole product cover, empty ones too.  b1_excess is the
    graph's b1 less that of the cover's nerve.  Cells that were too large for their clusterer
    have label -2 and are counted as skipped.
    """
    if unknown := [g for g in groups if g not in MEASURES]:
        raise ValueError(f"unknown measures {unknown}; known: {', '.join(MEASURES)}")
    by = [F.col(key)] if key else [F.lit("all").alias("graph")]
    name = key or "graph"
    own = nodes.select(*by, "cell", "label", "id")
    live = own.filter("label >= 0").withColumn("node", F.concat_ws("/", "cell", "label"))
    plan = cells.select(*by, "cell", "id")
    count = F.count(F.lit(1))
    size = live.groupBy(name, "node").agg(count.alias("s"))
    rows = [size.groupBy(name).agg(count.alias("n_nodes"), F.sum("s").alias("membership"), F.avg("s").alias("node_mean"), F.median("s").alias("node_median"), F.max("s").alias("node_max"), F.min("s").alias("node_min"))]
    rows.append(plan.groupBy(name, "cell").agg(count.alias("s")).groupBy(name).agg(count.alias("n_nonempty"), F.median("s").alias("cell_size_median"), F.max("s").alias("cell_size_max"), F.sum("s").alias("_held")))
    rows.append(live.groupBy(name).agg(F.count_distinct("id").alias("_covered")))
    rows.append(own.groupBy(name).agg(F.count_distinct(F.when(F.col("label") == -2, F.col("cell"))).alias("skipped_cells")))
    per_cell = live.groupBy(name, "cell").agg(F.count_distinct("label").alias("c"))
    rows.append(per_cell.groupBy(name).agg(F.round(F.avg("c"), 4).alias("cpc_mean"), F.round(F.avg((F.col("c") == 1).cast("double")), 4).alias("cpc_frac_1"), F.max("c").alias("cpc_max")))
    rows.append(_structure(live.select(name, "id", "node"), name, ("n_edges", "b0", "mean_degree", "max_degree", "branch_points", "leaves", "isolated", "largest_component", "density", "mean_clustering", "diameter"), "expensive" in groups))
    nerve = _structure(plan.select(name, "id", F.col("cell").alias("node")), name, ("n_edges", "b0", "n_nodes"), False)
    rows.append(nerve.select(name, F.col("n_nodes").alias("nerve_V"), F.col("n_edges").alias("nerve_E"), F.col("b0").alias("nerve_b0"), (F.col("n_edges") - F.col("n_nodes") + F.col("b0")).alias("nerve_b1")))
    out = plan.select(name).distinct()
    for x in rows:
        out = out.join(x, name, "left")
    zero = [c for c in out.columns if c != name]
    out = out.na.fill(0, zero)
    out = out.withColumns({
        "n_cells": F.lit(n_cells).cast("long"), "empty_frac": F.round(1 - F.col("n_nonempty") / n_cells, 4), "node_ratio": F.round(F.col("n_nodes") / F.greatest("n_nonempty", F.lit(1)), 4),
        "mean_cells_per_point": F.round(F.col("_held") / points, 4), "covered": F.round(F.col("_covered") / points, 4), "b1": F.col("n_edges") - F.col("n_nodes") + F.col("b0"), "n_components": F.col("b0"),
    }).withColumn("b1_excess", F.col("b1") - F.col("nerve_b1"))
    return out.select(*([name] if key else []), *[m for g in groups for m in MEASURES[g]])


def _structure(members: DataFrame, name: str, columns: tuple[str, ...], deep: bool) -> DataFrame:
    """Edges, components and degrees of the graphs of nodes that share points: (name, n_nodes and the columns).

    A Mapper graph is as small as its cover, so its edges are walked in one group a graph; the memberships never are.
    """
    own = members.groupBy(name, "id").agg(F.array_sort(F.collect_set("node")).alias("c")).filter(F.size("c") > 1)
    edges = own.withColumn("a", F.explode("c")).withColumn("b", F.explode("c")).filter("a < b").select(name, "a", "b").distinct()
    nodes = members.select(name, F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).distinct()

    def run(key, t):
        a, b = t["a"].to_pylist(), t["b"].to_pylist()
        at = {x: i for i, x in enumerate(sorted(x for x, y in zip(a, b) if y is None))}
        pairs = [(at[x], at[y]) for x, y in zip(a, b) if y is not None]
        n, part, degree = len(at), Union(len(at)), np.zeros(len(at), int)
        near: list[set] = [set() for _ in at]
        for x, y in pairs:
            part.join(x, y)
            degree[[x, y]] += 1
            near[x].add(y)
            near[y].add(x)
        sizes = np.bincount(part.labels()) if n else np.zeros(0, int)
        row = {
            "n_nodes": n, "n_edges": len(pairs), "b0": len(sizes), "mean_degree": round(float(degree.mean()), 4), "max_degree": int(degree.max()), "branch_points": int((degree >= 3).sum()),
            "leaves": int((degree == 1).sum()), "isolated": int((degree == 0).sum()), "largest_component": int(sizes.max()), "density": 0.0, "mean_clustering": 0.0, "diameter": 0.0,
        }
        if deep:
            labels = part.labels()
            shares = [sum(len(near[y] & near[x]) for y in near[x]) / (len(near[x]) * (len(near[x]) - 1)) if len(near[x]) > 1 else 0.0 for x in range(n)]
            row |= {"density": 2 * len(pairs) / (n * (n - 1)) if n > 1 else 0.0, "mean_clustering": float(np.mean(shares)), "diameter": float(_diameter(near, np.flatnonzero(labels == sizes.argmax()).tolist()))}
        return pa.table({name: pa.array([key[0].as_py()], t.schema.field(name).type), **{c: pa.array([row[c]], pa.int64() if isinstance(row[c], int) else pa.float64()) for c in ("n_nodes", *[c for c in columns if c != "n_nodes"])}})

    real = ("mean_degree", "density", "mean_clustering", "diameter")
    schema = ", ".join([f"{name} {members.schema[name].dataType.simpleString()}", "n_nodes long", *[f"{c} {'double' if c in real else 'long'}" for c in columns if c != "n_nodes"]])
    out = nodes.unionByName(edges).groupBy(name).applyInArrow(run, schema)
    return out if "n_nodes" in columns else out.drop("n_nodes")


def _diameter(near: list[set], part: list[int]) -> int:
    most = 0
    for s in part:
        level, seen, hops = {s}, {s}, 0
        while level := set().union(*(near[x] for x in level)) - seen:
            seen |= level
            hops += 1
        most = max(most, hops)
    return most


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bundle, n, repeated, loops, dangling, bad_weights, twice): counts of rows that break the rules of a graph of nodes (bundle, node) and edges (bundle, u, v, w).

    repeated: nodes listed again; loops: edges from a node to itself; dangling: ends that are no
    node; bad_weights: null or NaN; twice: pairs with a further edge, in either direction.
    """
    n = nodes.groupBy("bundle").agg(F.count_distinct("node").alias("n"), (F.count(F.lit(1)) - F.count_distinct("node")).alias("repeated"))
    own = edges.groupBy("bundle").agg(F.count_if(F.col("u") == F.col("v")).alias("loops"), F.count_if(F.col("w").isNull() | F.isnan("w")).alias("bad_weights"))
    ends = edges.select("bundle", F.explode(F.array("u", "v")).alias("node"))
    dangling = ends.join(nodes, ["bundle", "node"], "left_anti").groupBy("bundle").agg(F.count(F.lit(1)).alias("dangling"))
    pairs = edges.groupBy("bundle", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count(F.lit(1)).alias("c")).groupBy("bundle").agg(F.sum(F.col("c") - 1).alias("twice"))
    out = n.join(own, "bundle", "left").join(dangling, "bundle", "left").join(pairs, "bundle", "left").na.fill(0)
    return out.select("bundle", "n", "repeated", "loops", "dangling", "bad_weights", "twice")


def node_colour(members: DataFrame, by, values: DataFrame | None = None, normalise: str = "raw") -> DataFrame:
    """(cell, label, colour) of the nodes of memberships (cell, label, id): size, degree, or the mean of values (id, v) over the members (scalar), their most frequent label (label) or number of labels (diversity); or a function of the members' ids.

    normalise: raw, zscore over the nodes (population deviation), or for diversity vs_expected: over the number expected of as many draws.
    """
    own = members.filter("label >= 0")
    keys = ["cell", "label"]
    if callable(by):  # of the members' ids, a node a call

        def run(key, t):
            return pa.table({"cell": pa.array([key[0].as_py()], pa.string()), "label": pa.array([key[1].as_py()], pa.int32()), "colour": pa.array([float(by(np.sort(t["id"].to_numpy())))])})

        out = own.groupBy(*keys).applyInArrow(run, "cell string, label int, colour double")
    elif by == "size":
        out = own.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("colour"))
    elif by == "degree":
        name = F.concat_ws("/", "cell", "label")
        e = mp.nerve_edges(own.select("id", name.alias("node")), "node")
        ends = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
        out = own.select(*keys, name.alias("node")).distinct().join(ends, "node", "left").select(*keys, F.coalesce("d", F.lit(0)).cast("double").alias("colour"))
    elif by == "scalar":
        out = own.join(values, "id").groupBy(*keys).agg(F.avg("v").alias("colour"))
    elif by in ("label", "diversity"):
        per = own.join(values, "id").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
        node = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("top"))
        colour = F.col("top" if by == "label" else "d").cast("double")
        if normalise == "vs_expected":
            m = values.agg(F.count_distinct("v").alias("m"))
            expected = F.col("m") * (1 - F.pow(1 - 1 / F.col("m"), F.col("n")))
            return node.join(F.broadcast(m)).select(*keys, (colour / (expected + 1e-12)).alias("colour"))  # one row
        out = node.select(*keys, colour.alias("colour"))
    else:
        raise ValueError(f"unknown colour {by!r}")
    if normalise == "zscore":
        s = out.agg(F.avg("colour").alias("_m"), F.stddev_pop("colour").alias("_s"))
        return out.join(F.broadcast(s)).select(*keys, ((F.col("colour") - F.col("_m")) / (F.col("_s") + 1e-12)).alias("colour"))  # one row
    if normalise != "raw":
        raise ValueError(f"unknown normalisation {normalise!r}")
    return out
