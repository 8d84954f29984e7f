"""One object from a table of points or weights to a table of diagrams, Mapper nodes or dimensions."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import diagrams as dg, geodesic as geo, mapper as mp, points as pt, series as se, weights as wt
from .presets import PRESETS

_BUILDERS = ("activation_graph", "labelled_complex_graph", "polyhedral_graph", "weight_graph")


class Analysis:
    """A builder and a tool with their settings; fit plans the work and returns a DataFrame.

    Points are (bundle, id, x[, label]), weights (layer_idx, i, j, w); every bundle is analysed by itself,
    so many models, layers or epochs are one query.
    """

    def __init__(self, builder: str | Callable | None = None, tool: str = "ph", builder_options: dict | None = None, tool_options: dict | None = None):
        self.builder, self.tool = builder, tool
        self.builder_options, self.tool_options = dict(builder_options or {}), dict(tool_options or {})
        self.validate()

    @classmethod
    def from_preset(cls, name: str, **over) -> Analysis:
        """A preset; builder__x and tool__x override single settings."""
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
        p = copy.deepcopy(PRESETS[name])
        for key, value in over.items():
            part, _, option = key.partition("__")
            if part not in ("builder", "tool") or not option:
                raise ValueError(f"unknown setting {key!r}")
            p[f"{part}_options"][option] = value
        return cls(p["builder"], p["tool"], p["builder_options"], p["tool_options"])

    def validate(self) -> None:
        b, t = self.builder, self.tool
        if b is not None and not callable(b) and b not in _BUILDERS:
            raise ValueError(f"unknown builder {b!r}")
        if t not in ("ph", "mapper", "dimension"):
            raise ValueError(f"unknown tool {t!r}")
        if b == "weight_graph":
            if self.builder_options.get("induced_paths") and self.builder_options.get("scope") != "full":
                raise ValueError("induced paths need the scope full")
            if t == "mapper" and not self.builder_options.get("features"):
                self.builder_options["features"] = 2
                warnings.warn("Mapper needs features of nodes: two Laplacian eigenvectors are used", UserWarning, stacklevel=3)
        if b == "activation_graph" and t == "ph" and self.builder_options.get("distance") == "correlation":
            warnings.warn("the diagrams are of distances between neurons, not samples", UserWarning, stacklevel=3)

    def explain(self) -> str:
        name = getattr(self.builder, "__name__", self.builder) or "the cloud itself"
        return f"{name} {self.builder_options} -> {self.tool} {self.tool_options}"

    def fit(self, data: DataFrame, activations: DataFrame | None = None) -> DataFrame:
        if callable(self.builder):
            return self._read(self.builder(data, **self.builder_options), "euclidean")
        if self.builder == "weight_graph":
            return self._weights(data, activations)
        if self.builder is None:
            return self._read(data, "euclidean")
        o = self.builder_options
        if self.builder == "labelled_complex_graph":
            source = o.get("source")
            source = data.agg(F.min("label")).first()[0] if source is None else source
            how = o.get("distance", "euclidean")
            if o.get("scale", "global") == "local":
                if self.tool != "ph":
                    raise ValueError("a local scale gives distances, not points: use the tool ph")
                pairs = pt.labelled_complex(data, source, o.get("quantile", 0.5), o.get("gamma"), "local", o.get("k_local", 5), how)
                t = self.tool_options
                return self._summed(dg.matrix_diagrams(pairs.select(F.lit("all").alias("bundle"), "i", "j", "d"), "distance", t.get("max_dim", 1), t.get("threshold", float("inf")), t.get("coeff", 2)))
            near = pt.labelled_vertices(data, source, o.get("quantile", 0.5), how, gamma=o.get("gamma"))
            return self._read(data.join(near.select("id"), "id", "left_semi"), how)
        if self.builder == "polyhedral_graph":
            bits = F.transform("x", lambda v: (v > 0).cast("double"))
            regions = data.groupBy("bundle", bits.alias("x")).agg(F.min("id").alias("id"))
            return self._read(regions.select("bundle", "id", "x"), "hamming")
        how = o.get("distance", "euclidean")
        if how == "geodesic" and self.tool == "ph":
            return self._geodesic(data)
        if how == "correlation":
            return self._read(neurons(data, o.get("drop_constant", False), o.get("max_neurons"), o.get("seed", 0)), "abs_correlation")
        if how == "vne":
            return self._read(_scaled(data), "euclidean")
        return self._read(data, how)

    def fit_many(self, tables: dict[str, DataFrame]) -> DataFrame:
        """One query over several tables; their names lead the bundle names."""
        out = None
        for name, t in tables.items():
            own = t.withColumn("bundle", F.concat_ws("/", F.lit(name), F.col("bundle").cast("string"))) if "bundle" in t.columns else t.withColumn("bundle", F.lit(name))
            out = own if out is None else out.unionByName(own)
        if out is None:
            raise ValueError("no tables")
        return self.fit(out)

    def _geodesic(self, data: DataFrame) -> DataFrame:
        k, top = self.builder_options.get("k"), self.tool_options.get("max_dim", 1)
        if k is not None:
            return geo.diagrams(data, [k], top).select("bundle", "dim", "birth", "death")
        ks = list(range(*self.builder_options.get("k_range", (2, 16))))
        best = geo.optimal_k(data, ks)
        return geo.diagrams(data, ks, top).join(best, ["bundle", "k"], "left_semi").select("bundle", "dim", "birth", "death")

    def _weights(self, weights: DataFrame, activations: DataFrame | None) -> DataFrame:
        o, t = self.builder_options, self.tool_options
        if o.get("layers") is not None:
            weights = weights.filter(F.col("layer_idx").isin(list(o["layers"])))
        if self.tool == "ph" and t.get("complex") == "directed_clique":
            bars = wt.clique_diagram(wt.clique_relevance(weights, t.get("relevance_mode", "positive")))
            return self._summed(bars.select(F.lit("all").alias("bundle"), "dim", "birth", "death"))
        edges = wt.edge_weights(weights, o.get("edge_weight", "absolute"), activations)
        if o.get("induced_paths"):
            layers = weights.agg(F.max("layer_idx")).first()[0] + 1
            paths = wt.induced_paths(edges, layers)
            graph = paths.select(F.lit("all").alias("bundle"), F.concat_ws("-", "from_layer", "i").alias("u"), F.concat_ws("-", "to_layer", "k").alias("v"), F.col("r").alias("w"))
        else:
            alone = o.get("scope", "multipartite") == "bipartite"
            bundle = F.col("layer_idx").cast("string") if alone else F.lit("all")
            graph = edges.select(bundle.alias("bundle"), F.concat_ws("-", "layer_idx", "i").alias("u"), F.concat_ws("-", F.col("layer_idx") + 1, "j").alias("v"), F.col("r").alias("w"))
        graph = graph.filter("w <> 0") if self.tool != "ph" else graph
        if self.tool == "ph":
            if t.get("max_dim", 0) == 0:
                return self._summed(wt.superlevel_h0(graph).select("bundle", F.lit(0).alias("dim"), "birth", "death"))
            return self._summed(mp.graph_diagrams(graph, "max_minus", t["max_dim"]))
        nodes = wt.node_features(graph, o.get("features", 2))
        order = F.dense_rank().over(Window.partitionBy("bundle").orderBy("node"))
        return self._read(nodes.select("bundle", order.cast("long").alias("id"), F.col("features").alias("x")), "euclidean")

    def _summed(self, bars: DataFrame) -> DataFrame:
        how = self.tool_options.get("statistics")
        return dg.statistics(bars) if how == "suite" else dg.moments(bars) if how == "moments" else bars

    def _read(self, points: DataFrame, metric: str) -> DataFrame:
        t = self.tool_options
        if self.tool == "ph":
            return self._summed(dg.rips_diagrams(points, t.get("max_dim", 1), t.get("threshold", float("inf")), metric, t.get("coeff", 2)))
        if self.tool == "dimension":
            if t.get("method", "global") == "global":
                return se.global_dimension(points)
            if t["method"] in ("ph_euclidean", "ph_loss"):
                return se.ph_dimension(points, t.get("alpha", 1.0), t.get("sizes"), t.get("seed", 0), "mean_difference" if t["method"] == "ph_loss" else "euclidean")
            kind = {"local": se.local_dimension, "calibrated": se.calibrated_dimension, "magnitude": se.magnitude_dimension}[t["method"]]
            return kind(points, **{k: v for k, v in t.items() if k != "method"})
        return mapper_nodes(points, t.get("lens", "l2_norm"), t.get("n_intervals", 10), t.get("overlap", 0.3), t.get("clusterer", "dbscan"), **t.get("how", {"eps": 0.5, "min_samples": 5}))


def mapper_nodes(points: DataFrame, lens: str | Callable, n_intervals: int, overlap: float, clusterer: str, **how) -> DataFrame:
    """(cell, label, id) of a cloud under a lens: see mapper.resolve_lens."""
    v = mp.resolve_lens(points, lens)
    return mp.cluster_cells(points, mp.cover(v, n_intervals, overlap), clusterer, **how)


def _scaled(points: DataFrame) -> DataFrame:
    """Coordinates over their population deviation within the bundle (0 counts as 1)."""
    long = points.select("bundle", "id", F.posexplode("x").alias("c", "v"))
    s = long.groupBy("bundle", "c").agg(F.stddev_pop("v").alias("s"))
    v = F.col("v") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return long.join(s, ["bundle", "c"]).groupBy("bundle", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", v.alias("v")))), lambda x: x["v"]).alias("x"))


def neurons(points: DataFrame, drop_constant: bool = False, most: int | None = None, seed: int = 0) -> DataFrame:
    """(bundle, id, x): the coordinates of samples (bundle, id, x) as points over the samples.

    drop_constant leaves out those of variance 1e-12 or less; most draws that many without replacement, the likelier the
    more samples they are largest in (a neuron that never is gets the mass of one sample, shared with its like).
    """
    long = points.select("bundle", "id", F.posexplode("x").alias("c", "v"))
    per = long.groupBy("bundle", "c").agg(F.var_pop("v").alias("var"))
    keep = per.filter("var > 1e-12") if drop_constant else per
    if most is not None:
        top = long.join(keep, ["bundle", "c"], "left_semi").groupBy("bundle", "id").agg(F.max_by("c", F.struct(F.abs("v"), -F.col("c"))).alias("c"))
        share = keep.join(top.groupBy("bundle", "c").agg(F.count(F.lit(1)).alias("m")), ["bundle", "c"], "left")
        w = Window.partitionBy("bundle")
        never = F.greatest(F.lit(1), F.count_if(F.col("m").isNull()).over(w))
        p = F.coalesce(F.col("m").cast("double"), 1 / never)
        # A key of -ln(u) / p by neuron: the smallest are a draw without replacement.
        u = (F.pmod(F.xxhash64("bundle", "c", F.lit(seed)), F.lit(2**40)) + 1) / float(2**40 + 2)
        drawn = share.withColumn("key", -F.log(u) / p)
        keep = drawn.withColumn("r", F.row_number().over(w.orderBy("key", "c"))).filter(F.col("r") <= most)
    own = long.join(keep.select("bundle", "c"), ["bundle", "c"], "left_semi")
    return own.groupBy("bundle", F.col("c").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("s"), "v"))), lambda x: x["v"]).alias("x"))
