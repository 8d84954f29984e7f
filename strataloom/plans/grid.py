"""Grids of Mapper settings as one Spark job, and the graphs they leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graphs as gr, mapper as mp, preprocess as pp
from ..sources import store
from ..sources.scratch import written
from . import sweep as sw

#: Settings of a configuration and their defaults.
AXES = {"cloud": None, "preprocess": None, "lens": "pca2", "n_intervals": 10, "overlap": 0.3, "metric": "euclidean", "clusterer": "dbscan", "eps": None, "cut": None, "min_samples": 5, "min_cluster_size": 5, "relative_gap": None}
_NEEDS = {"dbscan": ("eps", "min_samples"), "single": ("cut",), "ward": ("cut",), "first_gap": ("relative_gap",), "hdbscan": ("min_cluster_size",)}


def validate(config: dict, n_features: int | None = None) -> str | None:
    """Why a configuration can't run; None if it can."""
    if unknown := set(config) - set(AXES):
        return f"unknown settings {sorted(unknown)}"
    c = AXES | config
    if c["clusterer"] not in _NEEDS:
        return f"unknown clusterer {c['clusterer']!r}"
    if missing := [k for k in _NEEDS[c["clusterer"]] if c[k] is None]:
        return f"{c['clusterer']} needs {', '.join(missing)}"
    if c["clusterer"] == "ward" and c["metric"] != "euclidean":
        return "ward linkage is of Euclidean distances only"
    if c["metric"] == "cosine" and c["preprocess"] == "l2":
        return "cosine distances of points of length 1 order like Euclidean ones: the setting is there twice"
    if isinstance(c["lens"], str):
        name = c["lens"].rstrip("0123456789")
        k = int(c["lens"][len(name) :] or 1)
        if name not in ("pca", "coord", "l2", "l2_norm", "density", "eccentricity", "entropy"):
            return f"unknown lens {c['lens']!r}"
        if n_features is not None and (name == "pca" and k > n_features or name == "coord" and k >= n_features):
            return f"lens {c['lens']!r} needs more than the {n_features} features"
    if not 0 <= float(c["overlap"]) < 1:
        return f"overlap {c['overlap']} is outside [0, 1); convert_overlap turns width ratios into shares"
    n = c["n_intervals"]
    if min(n if isinstance(n, list) else [n]) < 1:
        return "n_intervals must be 1 at least"
    return None


class MapperGrid:
    """Every combination of Mapper settings over named clouds (id, x).

    run() checks all configurations first, then plans them as one query: a lens is made once
    for the configurations that share it, the covers of all stand in one table with their
    configuration, and one grouped call clusters the cells of all of them.
    """

    def __init__(self, clouds: dict[str, DataFrame], axes: dict[str, object], groups: tuple[str, ...] = ("size", "cover", "lattice", "topology", "shape"), measures: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        """measures: further ones by name, functions of the memberships (hash, cell, label, id) that give (hash, value)."""
        self.clouds, self.groups, self.measures = clouds, groups, measures or {}
        self.axes = {"cloud": list(clouds)} | axes
        self.configs = [AXES | c for c in sw.expand_grid(self.axes)]
        self.features = {name: len(x.first()["x"]) for name, x in clouds.items()}

    def checked(self) -> list[tuple[str, dict, str | None]]:
        """(hash, configuration, why it can't run) of each."""
        return [(sw.config_hash(c), c, validate(c, self.features.get(c["cloud"]))) for c in self.configs]

    def graphs(self, done: set[str] = frozenset()) -> tuple[DataFrame | None, DataFrame | None, dict[str, dict]]:
        """(memberships (hash, cell, label, id), covers (hash, cell, id), figures by hash) of the configurations that can run and aren't done."""
        ready: dict = {}
        covers, points, about = None, None, {}
        how: dict[str, tuple] = {}
        read: dict[tuple, dict] = {}  # settings read off a cloud
        for h, c, why in self.checked():
            if why or h in done:
                continue
            shape = (c["cloud"], repr(c["preprocess"]))
            if shape not in ready:
                own = pp.prepare(self.clouds[c["cloud"]].select("id", "x"), c["preprocess"])
                ready[shape] = (own, own.count(), {})
            own, n, lenses = ready[shape]
            key = repr(c["lens"])
            if key not in lenses:  # made once for all configurations that share it
                made = written(mp.resolve_lens(own, c["lens"]), "lens")
                lenses[key] = made, len(made.first()["v"])
            lens, dims = lenses[key]
            ns = c["n_intervals"] if isinstance(c["n_intervals"], list) else [c["n_intervals"]] * dims
            settings = {k: c[k] for k in _NEEDS[c["clusterer"]]} | {"metric": c["metric"]}
            known = (*shape, c["clusterer"], repr(settings))
            if known not in read:
                read[known] = mp.calibrate(own, c["clusterer"], settings)
            how[h] = (c["clusterer"], read[known])
            about[h] = {"points": n, "n_cells": _product(ns)}
            cells = mp.cover(lens, ns, c["overlap"]).select(F.lit(h).alias("hash"), F.lit("|".join(map(str, shape))).alias("shape"), "cell", "id")
            covers = cells if covers is None else covers.unionByName(cells)
        for shape, (own, _, _) in ready.items():
            named = own.select(F.lit("|".join(map(str, shape))).alias("shape"), "id", "x")
            points = named if points is None else points.unionByName(named)
        if covers is None:
            return None, None, {}
        return mp.cluster_many(covers.join(points, ["shape", "id"]).select("hash", "cell", "id", "x"), how), covers.select("hash", "cell", "id"), about

    def run(self, spark: SparkSession, done: set[str] = frozenset()) -> DataFrame:
        """(hash, ordinal, status, error, config, the measures): a row for each configuration; measures are null for rejected and finished ones."""
        rows = [(h, i, "rejected" if why else "done" if h in done else "ok", why, repr({k: v for k, v in c.items() if v is not None})) for i, (h, c, why) in enumerate(self.checked())]
        configs = spark.createDataFrame(rows, "hash string, ordinal int, status string, error string, config string")
        nodes, covers, about = self.graphs(done)
        if nodes is None:
            return configs
        out = None
        for figures in sorted({(a["points"], a["n_cells"]) for a in about.values()}):
            own = [h for h, a in about.items() if (a["points"], a["n_cells"]) == figures]
            part = gr.measure(nodes.filter(F.col("hash").isin(own)), covers.filter(F.col("hash").isin(own)), *figures, self.groups, "hash")
            out = part if out is None else out.unionByName(part)
        for name, f in self.measures.items():
            out = out.join(f(nodes).select("hash", F.col("value").alias(name)), "hash", "left")
        return configs.join(out, "hash", "left")


def _product(values: list[int]) -> int:
    out = 1
    for v in values:
        out *= v
    return out


def save_graphs(nodes: DataFrame, covers: DataFrame, path: str) -> None:
    """Memberships (hash, cell, label, id) and covers (hash, cell, id) as Parquet, a folder for each configuration."""
    for name, df in (("members", nodes), ("cover", covers)):
        df.write.partitionBy("hash").parquet(f"{path}/{name}/data")
        df.sparkSession.createDataFrame([(f"mapper {name}", store.VERSION)], "kind string, version int").coalesce(1).write.json(f"{path}/{name}/about")


def load_graph(spark: SparkSession, path: str, config: str) -> tuple[DataFrame, DataFrame]:
    """(memberships (cell, label, id), edges (u, v, w)) of a stored configuration; only its folder is read."""
    members = store.load(spark, f"{path}/members", "mapper members").filter(F.col("hash") == config).drop("hash")
    return members, mp.node_graph(members)


def stored_nerve(spark: SparkSession, path: str, config: str) -> DataFrame:
    """(nodes, edges, b0, b1) of the nerve of a stored configuration's cover."""
    return mp.nerve_betti(store.load(spark, f"{path}/cover", "mapper cover").filter(F.col("hash") == config))
