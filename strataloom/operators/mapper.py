"""Mapper: cover of a lens, clusters in its cells, the graph of shared points and its measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import Union, dbscan_points, distance_block, elbow_points, hdbscan_points, linkage_labels, rips

#: Neighbour of the density lens.
DENSITY_K = 200


def convert_overlap(value: float, frm: str = "width_ratio", to: str = "standard") -> float:
    """Between overlap conventions: standard is the share g of an interval's width, width_ratio is 1 / (1 - g) - 1."""
    for name in (frm, to):
        if name not in ("standard", "width_ratio"):
            raise ValueError(f"unknown overlap convention {name!r}")
    g = value if frm == "standard" else 1 - 1 / (1 + value)
    return g if to == "standard" else 1 / (1 - g) - 1


def max_intervals(n: int, factor: float, members: int, dims: int, overlap: float) -> int:
    budget = n / (factor * members)
    return max(1, int(budget ** (1 / dims) / (1 - overlap))) if budget > 1 else 1


def intervals(lo: float, hi: float, n: int, overlap: float) -> list[tuple[float, float]]:
    """Closed intervals of width spacing/(1-overlap) around evenly spaced centres; one interval for a constant lens."""
    if hi <= lo:
        return [(lo - 0.5, lo + 0.5)]
    s = (hi - lo) / n
    return [(lo + s * (i + 0.5) - s / (1 - overlap) / 2, lo + s * (i + 0.5) + s / (1 - overlap) / 2) for i in range(n)]


def cover(lens: DataFrame, n_intervals: list[int] | int, overlap: float) -> DataFrame:
    """(id, cell): cells of the product cover that hold each point of lens (id, v array<double>); cell is the interval of each axis.

    The intervals are known by arithmetic, so a point explodes into its own cells and nothing is joined.
    """
    dims = len(lens.first()["v"]) if not isinstance(n_intervals, list) else len(n_intervals)
    ns = n_intervals if isinstance(n_intervals, list) else [n_intervals] * dims
    r = lens.agg(*[f(F.col("v")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = lens
    for d, n in enumerate(ns):
        iv = intervals(float(r[f"lo{d}"]), float(r[f"hi{d}"]), n, overlap)
        v = F.col("v")[d]
        hits = [F.when((v >= a) & (v <= b), F.lit(i)) for i, (a, b) in enumerate(iv)]
        out = out.withColumn(f"_c{d}", F.explode(F.array_compact(F.array(*hits))))
    return out.select("id", F.concat_ws("-", *[f"_c{d}" for d in range(len(ns))]).alias("cell"))


def nerve_edges(cells: DataFrame, key: str = "cell") -> DataFrame:
    """(a, b, shared): cells with common points.  Pairs come from each point's own few cells."""
    own = cells.groupBy("id").agg(F.array_sort(F.collect_set(key)).alias("c")).filter(F.size("c") > 1)
    pair = own.withColumn("a", F.explode("c")).withColumn("b", F.explode("c")).filter("a < b")
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def components(nodes: list, edges: list[tuple]) -> int:
    at = {x: i for i, x in enumerate(nodes)}
    u = Union(len(nodes))
    return len(nodes) - sum(u.join(at[a], at[b]) for a, b in edges)


def nerve_betti(cells: DataFrame, key: str = "cell") -> DataFrame:
    """(nodes, edges, b0, b1) of the 1-skeleton.  The cover's graph is as small as the cover, so it is walked in one group."""
    nodes, edges = cells.select(F.col(key).alias("a")).distinct().withColumn("b", F.lit(None).cast(cells.schema[key].dataType)), nerve_edges(cells, key).select("a", "b")

    def run(t):
        a, b = t["a"].to_pylist(), t["b"].to_pylist()
        n, e = [x for x, y in zip(a, b) if y is None], [(x, y) for x, y in zip(a, b) if y is not None]
        b0 = components(n, e)
        return pa.table({k: pa.array([v], pa.int64()) for k, v in (("nodes", len(n)), ("edges", len(e)), ("b0", b0), ("b1", len(e) - len(n) + b0))})

    return nodes.unionByName(edges).groupBy(F.lit("all")).applyInArrow(run, "nodes long, edges long, b0 long, b1 long")


def _cell_labels(x: np.ndarray, clusterer, max_cell: int, how: dict) -> np.ndarray:
    """Labels of a cell's points: -1 noise, -2 all of a cell too large for its clusterer."""
    n, metric = len(x), how.get("metric", "euclidean")
    if callable(clusterer):
        return np.asarray(clusterer(x, **how), int)
    if clusterer == "dbscan":
        few = how["min_samples"]
        return np.zeros(n, int) if n <= few else dbscan_points(x, elbow_points(x, few, metric) if how["eps"] == "elbow" else how["eps"], few, metric)
    if clusterer == "hdbscan":
        few = how["min_cluster_size"]
        return np.zeros(n, int) if n <= few else hdbscan_points(x, few, metric)
    if n > max_cell:
        return np.full(n, -2)
    d = distance_block(x, x, metric)
    if clusterer == "first_gap":
        return linkage_labels(d, method=how.get("method", "single"), relative_gap=how["relative_gap"])
    return linkage_labels(d, how["cut"], "single" if clusterer == "single" else clusterer)


def cluster_cells(points: DataFrame, cells: DataFrame, clusterer: str = "single", max_cell: int = 8000, **how) -> DataFrame:
    """(cell, label, id): clusters in each cell of points (id, x); noise is left out.

    Clusterers: single (cut), first_gap (relative_gap, method), dbscan (eps or "elbow" of the cell, min_samples), ward (cut),
    hdbscan (min_cluster_size), or a function of a cell's matrix that gives a label a row.  The linkage ones (single, first_gap, ward) hold a cell's distance matrix and mark the points of
    larger cells than max_cell by label -2; dbscan and hdbscan take cells of any size, in blocks.
    """
    own = cells.join(points.select("id", "x"), "id").select(F.lit("").alias("hash"), "cell", "id", "x")
    return cluster_many(own, {"": (clusterer, how)}, max_cell).drop("hash")


def cluster_many(members: DataFrame, how: dict[str, tuple[str, dict]], max_cell: int = 8000) -> DataFrame:
    """(hash, cell, label, id): the cells of several covers (hash, cell, id, x), each clustered as how has it for its hash (clusterer, settings)."""

    def run(key, t):
        t = t.sort_by("id")
        x = np.stack(t["x"].to_numpy(zero_copy_only=False)).astype(float)
        h, cell = (k.as_py() for k in key)
        clusterer, settings = how[h]
        labels = _cell_labels(x, clusterer, max_cell, settings)
        keep = labels != -1
        m = int(keep.sum())
        return pa.table({"hash": pa.array([h] * m, pa.string()), "cell": pa.array([cell] * m, pa.string()), "label": pa.array(labels[keep], pa.int32()), "id": pa.array(t["id"].to_numpy()[keep])})

    return members.groupBy("hash", "cell").applyInArrow(run, "hash string, cell string, label int, id long")


def graph_measures(nodes: DataFrame) -> DataFrame:
    """(nodes, edges, b0, b1, median_size, max_size, mean_degree, covered, skipped) of a Mapper graph from its memberships (cell, label, id).

    skipped counts the cells marked by label -2, which were too large for their clusterer.
    """
    skipped = nodes.filter("label = -2").agg(F.count_distinct("cell").alias("skipped"))
    own = nodes.filter("label >= 0").withColumn("node", F.concat_ws("/", "cell", "label"))
    sizes = own.groupBy("node").agg(F.count(F.lit(1)).alias("s")).agg(F.median("s").alias("median_size"), F.max("s").alias("max_size"))
    covered = own.agg(F.count_distinct("id").alias("covered"))
    graph = nerve_betti(own.select("id", "node"), "node").withColumn("mean_degree", F.round(2 * F.col("edges") / F.col("nodes"), 4))
    rest = skipped.join(F.broadcast(graph), F.lit(True), "left").na.fill(0, ["nodes", "edges", "b0", "b1"])  # no graph if all are skipped
    return rest.join(F.broadcast(sizes)).join(F.broadcast(covered)).select(*graph.columns, *sizes.columns, "covered", "skipped")  # a row each


def node_diversity(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, n, distinct, dominant, diversity): labels of each node against the number expected of n draws; ties go to the smallest label."""
    m = labels.agg(F.count_distinct("label").alias("m"))
    per = members.join(labels.select("id", "label"), "id").groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c"))
    node = per.groupBy("cell").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("dominant"))
    expected = F.col("m") * (1 - F.pow(1 - 1 / F.col("m"), F.col("n")))
    return node.join(F.broadcast(m)).select("cell", "n", "distinct", "dominant", (F.col("distinct") / expected).alias("diversity"))  # one row


def class_separation(node_labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(edges, mixed, score): share of edges (a, b) between nodes (cell, dominant) of different classes."""
    a, b = (node_labels.select(F.col("cell").alias(k), F.col("dominant").alias(f"_{k}")) for k in ("a", "b"))
    n, mixed = F.count(F.lit(1)), F.count_if(F.col("_a") != F.col("_b"))
    return edges.join(a, "a").join(b, "b").agg(n.alias("edges"), mixed.alias("mixed"), F.when(n > 0, mixed / n).otherwise(0.0).alias("score"))


def exemplars(points: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cell, rank, id): the k members nearest each node's centroid."""
    m = members.select("cell", "id").join(points.select("id", "x"), "id")
    long = m.select("cell", "id", F.posexplode("x").alias("c", "v"))
    centre = long.groupBy("cell", "c").agg(F.avg("v").alias("m"))
    d = long.join(centre, ["cell", "c"]).groupBy("cell", "id").agg(F.sum(F.pow(F.col("v") - F.col("m"), F.lit(2))).alias("d2"))
    # rounded, so that equal distances tie whatever the order of the sum
    r = F.row_number().over(Window.partitionBy("cell").orderBy(F.round("d2", 9), "id"))
    return d.withColumn("rank", r).filter(F.col("rank") <= k).select("cell", "rank", "id")


def codensity(points: DataFrame, k: int) -> DataFrame:
    """(id, v): distance of each point to its k-th neighbour, itself the first.  A cloud of no more than k points takes its last but one."""
    from .points import nearest_within

    k = max(1, min(k, points.count() - 1))
    if k == 1:
        return points.select(F.col("id").cast("long").alias("id"), F.lit(0.0).alias("v"))
    return nearest_within(points, k - 1, (), last=True).select(F.col("i").alias("id"), F.col("d").alias("v"))


def pca_lens(points: DataFrame, k: int) -> DataFrame:
    """(id, v): projections on the first k principal axes, from one pass of second moments; signs fixed by the largest component."""
    dims = len(points.first()["x"])

    def moments(batches):
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for t in batches:
            if t.num_rows:
                x = np.stack(t.column(0).to_numpy(zero_copy_only=False)).astype(float)
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()]), "ss": pa.array([ss.reshape(-1).tolist()])})

    rows = points.select("x").mapInArrow(moments, "n long, s array<double>, ss array<double>").collect()  # a row a partition
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["s"]) for r in rows) / n
    cov = sum(np.array(r["ss"]) for r in rows).reshape(dims, dims) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])

    def project(batches):
        for t in batches:
            x = np.stack(t.column(1).to_numpy(zero_copy_only=False)).astype(float) if t.num_rows else np.zeros((0, dims))
            yield pa.record_batch({"id": t.column(0), "v": pa.array(((x - mean) @ axes).tolist(), pa.list_(pa.float64()))})

    return points.select("id", "x").mapInArrow(project, "id long, v array<double>")


def _root_mean_square(points: DataFrame, rows_of) -> DataFrame:
    """eccentricity_lens of exponent 2: the mean of squared distances to all points is that to their mean, and the mean of theirs to it."""
    dims = len(points.first()["x"]) if points.take(1) else 1
    mean = points.agg(*[F.avg(F.col("x")[c]).alias(f"m{c}") for c in range(dims)]).first()
    m = np.array([v or 0.0 for v in mean], float)

    def run(batches):
        for t in batches:
            if t.num_rows:
                yield pa.record_batch({"id": t.column(0), "_q": pa.array(((rows_of(t.column(1)) - m) ** 2).sum(axis=1))})

    q = points.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, "id long, _q double")
    return q.join(F.broadcast(q.agg(F.avg("_q").alias("_c")))).select("id", F.array(F.sqrt(F.col("_q") + F.col("_c"))).alias("v"))  # one row


def eccentricity_lens(points: DataFrame, exponent: float = 2.0, metric: str = "euclidean", block: int | None = None) -> DataFrame:
    """(id, v): the norm of a point's distances to all points, each to the exponent and over their number; an infinite exponent takes the largest.

    Squares of Euclidean distances add up to those from the mean and a constant, so nothing is
    paired; others are made block by block and summed up by point.
    """
    from .points import BLOCK, distance_sums, rows_of

    if exponent == 2 and metric == "euclidean":
        return _root_mean_square(points, rows_of)
    d = distance_sums(points, exponent, metric, block or BLOCK)
    n = points.agg(F.count(F.lit(1)).alias("n"))
    if exponent == float("inf"):
        return d.groupBy("i").agg(F.max("m").alias("v")).select(F.col("i").alias("id"), F.array("v").alias("v"))
    total = d.groupBy("i").agg(F.sum("p").alias("s"))
    return total.join(F.broadcast(n)).select(F.col("i").alias("id"), F.array(F.pow(F.col("s") / F.col("n"), F.lit(1 / exponent))).alias("v"))  # one row


def entropy_lens(points: DataFrame) -> DataFrame:
    """(id, v): the entropy in bits of a point's coordinates, as shares of their sum; of their magnitudes if one is negative, 0 for a zero point."""
    some = F.when(F.exists("x", lambda v: v < 0), F.transform("x", lambda v: F.abs(v))).otherwise(F.col("x"))
    p = points.select("id", some.alias("x")).withColumn("_s", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    h = F.aggregate("x", F.lit(0.0), lambda a, v: a - F.when(v > 0, v / F.col("_s") * F.log2(v / F.col("_s"))).otherwise(0.0))
    return p.select("id", F.array(F.when(F.col("_s") > 0, h).otherwise(0.0)).alias("v"))


def row_lens(points: DataFrame, f) -> DataFrame:
    """(id, v): f of each point's coordinates (a NumPy row), a number or several; called over Arrow batches."""

    def run(batches):
        for t in batches:
            rows = [np.atleast_1d(np.asarray(f(np.asarray(x, float)), float)).tolist() for x in t.column(1).to_pylist()]
            yield pa.record_batch({"id": t.column(0), "v": pa.array(rows, pa.list_(pa.float64()))})

    return points.select("id", "x").mapInArrow(run, "id long, v array<double>")


def resolve_lens(points: DataFrame, lens) -> DataFrame:
    """(id, v) of a lens by name: l2 (or l2_norm), pcaN, umapN, tsne2, mdsN, coordN, density, eccentricity, entropy; or a callable of the whole table."""
    if callable(lens):
        return lens(points)
    if lens in ("l2", "l2_norm"):
        return points.select("id", F.array(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))).alias("v"))
    if lens == "density":
        return codensity(points, DENSITY_K).select("id", F.array("v").alias("v"))
    if lens == "eccentricity":
        return eccentricity_lens(points)
    if lens == "entropy":
        return entropy_lens(points)
    name, k = lens.rstrip("0123456789"), lens[len(lens.rstrip("0123456789")) :]
    if name == "pca":
        return pca_lens(points, int(k or 1))
    if name in ("umap", "tsne", "mds"):
        from . import embed

        if name == "tsne" and k not in ("", "2"):
            raise ValueError("the lens tsne has two dimensions")
        return embed.tsne(points) if name == "tsne" else {"umap": embed.umap, "mds": embed.landmark_mds}[name](points, int(k or 2))
    if name == "coord":
        return points.select("id", F.array(F.col("x")[int(k or 0)]).alias("v"))
    raise ValueError(f"unknown lens {lens!r}")


def quantile_distance(points: DataFrame, percent: float, metric: str = "euclidean", sample: int = 1500, seed: int = 0) -> float:
    """A percentile of the distances between the points of a sample (the least hashes of the ids, a stated number)."""
    x = np.array([r["x"] for r in points.select("id", "x").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()], float)
    d = distance_block(x, x, metric)
    return float(np.quantile(d[np.triu_indices(len(x), 1)], percent / 100)) if len(x) > 1 else 0.0


def calibrate(points: DataFrame, clusterer: str, how: dict, sample: int = 1500, seed: int = 0) -> dict:
    """Settings of a clusterer with numbers for its strategies, read off the whole cloud: ("quantile", percent) for eps or cut, "elbow" for eps."""
    out = dict(how)
    for name in ("eps", "cut"):
        v = out.get(name)
        if isinstance(v, (tuple, list)) and len(v) == 2 and v[0] == "quantile":
            out[name] = quantile_distance(points, float(v[1]), out.get("metric", "euclidean"), sample, seed)
        elif name == "eps" and v == "elbow":
            x = np.array([r["x"] for r in points.select("id", "x").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()], float)
            out[name] = float(elbow_points(x, out["min_samples"], out.get("metric", "euclidean")))
        elif v is not None and not isinstance(v, (int, float)):
            raise ValueError(f"unknown strategy {v!r} for {name}")
    return out


def graph_statistics(edges: DataFrame) -> DataFrame:
    """(bundle, nodes, edges, density, clustering, diameter, b0, b1) of Mapper graphs (bundle, u, v); diameter is of the largest component."""

    def run(key, t):
        u, v = t["u"].to_pylist(), t["v"].to_pylist()
        at = {x: i for i, x in enumerate(sorted({*u, *v}))}
        n = len(at)
        near = np.zeros((n, n), bool)
        for a, b in zip(u, v):
            near[at[a], at[b]] = near[at[b], at[a]] = a != b
        m, deg = int(near.sum()) // 2, near.sum(axis=1)
        x = near.astype(float)
        tri, wedge = np.diag(x @ x @ x), deg * (deg - 1)
        part = Union(n)
        for a, b in zip(*np.nonzero(near)):
            part.join(int(a), int(b))
        labels = part.labels()
        own = np.flatnonzero(labels == np.bincount(labels).argmax())
        sub, hops, reach = near[np.ix_(own, own)], 0, np.eye(len(own), dtype=bool)
        while not reach.all():
            reach, hops = reach | (reach.astype(np.float32) @ sub.astype(np.float32) > 0), hops + 1
        b0 = int(labels.max()) + 1
        row = {"nodes": n, "edges": m, "density": 2 * m / (n * (n - 1)) if n > 1 else 0.0, "clustering": float(np.where(wedge > 0, tri / np.maximum(wedge, 1), 0).mean()), "diameter": hops, "b0": b0, "b1": m - n + b0}
        return pa.table({"bundle": pa.array([key[0].as_py()], pa.string()), **{c: pa.array([y], pa.float64() if c in ("density", "clustering") else pa.int64()) for c, y in row.items()}})

    own = edges.select(F.col("bundle").cast("string").alias("bundle"), F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))
    return own.groupBy("bundle").applyInArrow(run, "bundle string, nodes long, edges long, density double, clustering double, diameter long, b0 long, b1 long")


def graph_diagrams(edges: DataFrame, how: str = "max_minus", max_dim: int = 1) -> DataFrame:
    """(bundle, dim, birth, death) of Mapper graphs (bundle, u, v, w): max_minus turns weights into distances max - w, reciprocal and
    one_minus into 1 / w and 1 - w, raw takes them.  An absent edge counts as weight 0 for max_minus and as distance 0 otherwise."""
    if how not in ("max_minus", "reciprocal", "one_minus", "raw"):
        raise ValueError(f"unknown weight conversion {how!r}")

    def run(key, t):
        u, v, w = (t[c].to_pylist() for c in ("u", "v", "w"))
        at = {x: i for i, x in enumerate(sorted({*u, *v}))}
        m = np.zeros((len(at), len(at)))
        for a, b, x in zip(u, v, w):
            m[at[a], at[b]] = m[at[b], at[a]] = x
        if how == "one_minus" and not all(0 <= x <= 1 for x in w) or how == "reciprocal" and 0 in w:
            raise ValueError(f"weights don't suit {how!r}")
        with np.errstate(divide="ignore"):
            d = {"max_minus": m.max() - m, "reciprocal": np.where(m > 0, 1 / m, 0), "one_minus": np.where(m > 0, 1 - m, 0), "raw": m}[how].copy()
        np.fill_diagonal(d, 0)
        bars = rips(d, max_dim)
        return pa.table({"bundle": pa.array([key[0].as_py()] * len(bars), pa.string()), "dim": pa.array([k for k, _, _ in bars], pa.int32()), "birth": pa.array([b for _, b, _ in bars], pa.float64()), "death": pa.array([e for _, _, e in bars], pa.float64())})

    own = edges.select(F.col("bundle").cast("string").alias("bundle"), F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("w").cast("double").alias("w"))
    return own.groupBy("bundle").applyInArrow(run, "bundle string, dim int, birth double, death double")


def node_graph(nodes: DataFrame) -> DataFrame:
    """(u, v, w): edges of the Mapper graph of memberships (cell, label, id), weighted by shared points."""
    own = nodes.filter("label >= 0").select("id", F.concat_ws("/", "cell", "label").alias("node"))
    return nerve_edges(own, "node").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("shared").cast("double").alias("w"))
