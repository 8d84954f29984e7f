"""The engine's queries over the driver's tables, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import compare as cp, diagrams as dg, embed as em, geodesic as geo, mapper as mp, points as pt, preprocess as pp, series as se, uncertainty as un, views as vw, weights as wt
from . import sweep as sw
from .analysis import Analysis, mapper_nodes, neurons

R = 6  # decimals at the query boundary: engines differ in the order of sums


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) + F.lit(0.0) for c in cols})  # no negative zero


def cloud(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))


def weights(s: SparkSession, d: str) -> DataFrame:
    """Three layers: supplier, line number, return flag; a weight is the mean discount less 0.05."""
    li = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("n"), (F.ascii("l_returnflag")).cast("long").alias("r"), (F.col("l_discount") - 0.05).alias("w"))
    a = li.groupBy(F.col("s").alias("i"), F.col("n").alias("j")).agg((F.round(F.avg("w"), R) + F.lit(0.0)).alias("w")).withColumn("layer_idx", F.lit(0))
    b = li.groupBy(F.col("n").alias("i"), F.col("r").alias("j")).agg((F.round(F.avg("w"), R) + F.lit(0.0)).alias("w")).withColumn("layer_idx", F.lit(1))
    return a.unionByName(b).select("layer_idx", "i", "j", "w")


def diagram(s: SparkSession, d: str) -> DataFrame:
    """Bars from events: a bundle for each type, two dimensions; every fiftieth bar never dies."""
    e = _t(s, d, "events")
    death = F.when(F.col("event_id") % 50 == 0, F.lit(float("inf"))).otherwise(F.round(F.col("value"), 3) + F.round((F.col("event_id") % 7 + 1) * 0.1, 1))
    return e.select(F.col("event_type").alias("bundle"), (F.col("user_id") % 2).cast("int").alias("dim"), F.round("value", 3).alias("birth"), death.alias("death"))


def trajectory(s: SparkSession, d: str) -> DataFrame:
    """Days as steps, event types as coordinates, mean values."""
    return _t(s, d, "events").groupBy(F.dayofyear("ts").alias("step"), F.col("event_type").alias("coord")).agg(F.avg("value").alias("v"))


def lens(s: SparkSession, d: str) -> DataFrame:
    return cloud(s, d).select("id", F.array(F.round(F.col("x")[0], R), F.round(F.col("x")[1], R)).alias("v"))


def _bundles(s: SparkSession, d: str) -> DataFrame:
    return cloud(s, d).withColumn("bundle", F.col("label").cast("string"))


def _tu(s: SparkSession, d: str) -> DataFrame:
    """Samples are groups of suppliers: activations of the suppliers and of the line number layer."""
    li = _t(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("sample"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").alias("q"))
    acts = [li.groupBy("sample", F.col(c).alias("i")).agg(F.avg("q").alias("a")).withColumn("layer_idx", F.lit(k)) for k, c in enumerate(("s", "n"))]
    acts = acts[0].unionByName(acts[1])
    labels = acts.select("sample", (F.col("sample") % 3).alias("label")).distinct()
    dia = un.tree_diagrams(weights(s, d), acts)
    return _round(un.scores(dia, labels, un.class_means(dia, labels)), "score")


def _betti0(s: SparkSession, d: str) -> DataFrame:
    """Components at three scales from the merge heights of each label's cloud."""
    bars = dg.rips_diagrams(_bundles(s, d), 0)
    return bars.withColumn("eps", F.explode(F.array(F.lit(1.1), F.lit(1.2), F.lit(1.3)))).groupBy("bundle", "eps").agg(F.count_if((F.col("birth") <= F.col("eps")) & (F.col("death") > F.col("eps"))).alias("b0"))


def _h1(s: SparkSession, d: str) -> DataFrame:
    """One-dimensional bars of each label's cloud."""
    return _round(dg.statistics(dg.rips_diagrams(_bundles(s, d), 1).filter("dim = 1")), "total_persistence", "persistence_norm", "entropy", "mean", "median", "max", "min", "std", "gini", "top1", "skew", "birth_mean", "birth_max")


def _neighbour_graph(s: SparkSession, d: str) -> DataFrame:
    """The cloud's graph of five nearest neighbours, as edges u < v with their lengths."""
    near = pt.nearest(cloud(s, d), 5).select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.round("d", R).alias("d")).distinct()
    return near.select(F.lit("all").alias("bundle"), "u", "v", "d")


def _plane(embedding: DataFrame) -> DataFrame:
    return embedding.select("id", F.round(F.col("v")[0], R).alias("v0"), F.round(F.col("v")[1], R).alias("v1"))


def _nerve_entries(s: SparkSession, d: str) -> DataFrame:
    """Points shared by the cells of the cover, as a similarity of cells numbered by their places."""
    place = lambda c: F.element_at(F.split(c, "-"), 1).cast("long") * 5 + F.element_at(F.split(c, "-"), 2).cast("long")
    return mp.nerve_edges(mp.cover(lens(s, d), 5, 0.3)).select(F.lit("all").alias("bundle"), place("a").alias("i"), place("b").alias("j"), F.col("shared").cast("double").alias("d"))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """Results of a Mapper sweep as a table: cover sizes of the lens over a grid of settings."""
    grid = sw.grid_table(s, {"n": [4, 6, 8], "overlap": [0.2, 0.3, 0.4, 0.5]})
    v = lens(s, d).agg(F.min(F.col("v")[0]).alias("lo"), F.max(F.col("v")[0]).alias("hi"))
    return grid.join(F.broadcast(v)).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("n") / (1 - F.col("overlap"))).select("ordinal", "n", "overlap", F.round(F.col("width"), R).alias("width"))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    c = mp.cover(lens(s, d).select("id", F.slice("v", 1, 1).alias("v")), 6, 0.3)
    return mp.cluster_cells(cloud(s, d), c, "single", cut=1.1)


def kernels(s: SparkSession, d: str) -> DataFrame:
    """Embeddings as convolution kernels: label x place in the label x 8 x 8."""
    o = cloud(s, d).withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1)
    v = o.select(F.lit(0).alias("layer_idx"), F.col("label").alias("o"), F.col("i").cast("long").alias("i"), F.posexplode("x").alias("p", "v"))
    return v.select("layer_idx", "o", "i", F.floor(F.col("p") / 8).alias("h"), (F.col("p") % 8).cast("long").alias("w"), F.round("v", 4).alias("v"))


def _digest(df: DataFrame, *keys: str) -> DataFrame:
    """Keys, length and weighted sum of the array column x."""
    s = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return df.select(*keys, F.size("x").cast("long").alias("dims"), (F.round(s, R - 1) + F.lit(0.0)).alias("mix"))


def _members(s: SparkSession, d: str) -> DataFrame:
    """Covers of the cloud by three lenses, as three graphs."""
    out = None
    for axis in range(3):
        v = cloud(s, d).select("id", F.array(F.round(F.col("x")[axis], R)).alias("v"))
        own = mp.cover(v, 5, 0.3).select(F.lit(f"axis{axis}").alias("graph"), F.col("cell").alias("node"), "id")
        out = own if out is None else out.unionByName(own)
    return out


def _compared(s: SparkSession, d: str, method: str) -> DataFrame:
    pairs = s.createDataFrame([("axis0", "axis1"), ("axis0", "axis2"), ("axis1", "axis2")], "a string, b string")
    return _round(cp.distances(_members(s, d), pairs, method), "distance")


def _graph(s: SparkSession, d: str) -> DataFrame:
    return mp.node_graph(_nodes(s, d)).withColumn("bundle", F.lit("all"))


STATS = ("total_persistence", "persistence_norm", "entropy", "mean", "median", "max", "min", "std", "gini", "top1", "skew", "birth_mean", "birth_max")
_SCHEDULE = [0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "two_nn_id": lambda s, d: _round(pt.two_nn(cloud(s, d)), "id"),
    "knn_topk": lambda s, d: _round(pt.nearest(cloud(s, d), 5), "d"),
    "nearest_cosine": lambda s, d: _round(pt.nearest(cloud(s, d), 1, "cosine"), "d"),
    "nearest_cityblock": lambda s, d: _round(pt.nearest(cloud(s, d), 1, "cityblock"), "d"),
    "nearest_correlation": lambda s, d: _round(pt.nearest(cloud(s, d), 1, "correlation"), "d"),
    "vne_nearest": lambda s, d: _round(pt.nearest(pt.standardise(cloud(s, d)), 1), "d"),
    "pairs_within": lambda s, d: _round(pt.pairs_within(cloud(s, d), 1.1), "d"),
    "density_filter": lambda s, d: _round(pt.density_filter(cloud(s, d), 10, 0.25), "density"),
    "labelled_vertices": lambda s, d: _round(pt.labelled_vertices(cloud(s, d), 0), "gap"),
    "activation_patterns": lambda s, d: pt.patterns(cloud(s, d)),
    "predicted_labels": lambda s, d: pt.predicted_labels(cloud(s, d)),
    "relevance_edges": lambda s, d: _round(wt.edge_weights(weights(s, d), "relevance"), "r"),
    "normalized_edges": lambda s, d: _round(wt.edge_weights(weights(s, d), "normalized"), "r"),
    "induced_paths": lambda s, d: _round(wt.induced_paths(wt.edge_weights(weights(s, d), "relevance"), 2), "r"),
    "row_norms": lambda s, d: _round(wt.matrix_view(weights(s, d), "row_norm"), "v"),
    "weight_norms": lambda s, d: _round(wt.weight_norms(weights(s, d)), "fro", "l1", "max_abs"),
    "magnitude_mask": lambda s, d: wt.prune_report(wt.magnitude_mask(weights(s, d), 0.4)),
    "directed_clique_diagram": lambda s, d: wt.clique_diagram(wt.clique_relevance(weights(s, d))).groupBy("dim", "birth", "death").agg(F.count(F.lit(1)).alias("n")),
    "superlevel_h0": lambda s, d: _round(wt.superlevel_h0(weights(s, d).select(F.lit("all").alias("bundle"), F.concat(F.lit("a"), F.col("layer_idx"), F.lit("-"), "i").alias("u"), F.concat(F.lit("a"), F.col("layer_idx") + 1, F.lit("-"), "j").alias("v"), F.abs("w").alias("w"))), "death"),
    "diagram_statistics": lambda s, d: _round(dg.statistics(diagram(s, d)), *STATS),
    "diagram_moments": lambda s, d: _round(dg.moments(diagram(s, d)), *(f"{n}_{k}" for k in ("b", "d", "b2", "d2") for n in ("mean", "std"))),
    "betti_number": lambda s, d: dg.betti_at(diagram(s, d), 10.0),
    "betti_curve": lambda s, d: _round(dg.betti_curve(diagram(s, d), 20), "t"),
    "landscape_topk": lambda s, d: _round(dg.landscape(diagram(s, d), 3, 10), "value"),
    "persistence_image": lambda s, d: _round(dg.image(diagram(s, d), 4, 5.0), "value"),
    "snap_diagram": lambda s, d: dg.snap(diagram(s, d), _SCHEDULE).groupBy("bundle", "dim", "birth", "death").agg(F.count(F.lit(1)).alias("n")),
    "diagram_multiplicity": lambda s, d: _round(dg.multiplicity(diagram(s, d)), "log_n"),
    "barcode_longest": lambda s, d: _round(dg.longest(diagram(s, d).withColumn("birth", F.col("birth")), 5).groupBy("bundle", "dim").agg(F.sum("life").alias("life")), "life"),
    "betti0_at_eps": _betti0,
    "h1_statistics": _h1,
    "knn_graph_h0": lambda s, d: _round(dg.graph_diagrams_of(_neighbour_graph(s, d), 0), "death"),
    "knn_graph_loops": lambda s, d: _round(dg.statistics(dg.graph_diagrams_of(_neighbour_graph(s, d)).filter("dim = 1")), *STATS),
    "sparse_rips_statistics": lambda s, d: _round(dg.statistics(dg.sparse_diagrams(_bundles(s, d), 0.5)), *STATS),
    "cover_cells": lambda s, d: mp.cover(lens(s, d), 5, 0.3).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")),
    "nerve_edges": lambda s, d: mp.nerve_edges(mp.cover(lens(s, d), 5, 0.3)),
    "nerve_betti": lambda s, d: mp.nerve_betti(mp.cover(lens(s, d), 5, 0.3)),
    "node_diversity": lambda s, d: _round(mp.node_diversity(mp.cover(lens(s, d), 5, 0.3), cloud(s, d)), "diversity"),
    "class_separation": lambda s, d: _round(mp.class_separation(mp.node_diversity(mp.cover(lens(s, d), 5, 0.3), cloud(s, d)), mp.nerve_edges(mp.cover(lens(s, d), 5, 0.3))), "score"),
    "node_exemplars": lambda s, d: mp.exemplars(cloud(s, d), mp.cover(lens(s, d).select("id", F.slice("v", 1, 1).alias("v")), 6, 0.3), 3),
    "mapper_nodes": lambda s, d: _nodes(s, d).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")),
    "mapper_measures": lambda s, d: mp.graph_measures(_nodes(s, d)),
    "pca_lens": lambda s, d: mp.pca_lens(cloud(s, d), 2).select("id", F.round(F.col("v")[0], R).alias("v0"), F.round(F.col("v")[1], R).alias("v1")),
    "umap_lens": lambda s, d: _plane(mp.resolve_lens(cloud(s, d), "umap2")),
    "tsne_lens": lambda s, d: _plane(mp.resolve_lens(cloud(s, d), "tsne2")),
    "mds_lens": lambda s, d: _plane(mp.resolve_lens(cloud(s, d), "mds2")),
    "node_positions": lambda s, d: _plane(em.node_positions(_nerve_entries(s, d), "similarity").withColumnRenamed("i", "id")),
    "trajectory_distance": lambda s, d: _round(se.step_distances(trajectory(s, d)), "d"),
    "trajectory_loss_difference": lambda s, d: _round(se.step_distances(trajectory(s, d), "loss_difference"), "d"),
    "trajectory_smooth": lambda s, d: _round(se.smooth(trajectory(s, d).withColumnRenamed("coord", "key")), "v", "s"),
    "trajectory_settle": lambda s, d: se.settle(trajectory(s, d).withColumnRenamed("coord", "key"), 0.8),
    "rolling_steps": lambda s, d: _round(se.rolling_groups(trajectory(s, d), 10, 5).groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "mean"),
    "grid_expand": _sweep,
    "plateaus": lambda s, d: sw.plateaus(_sweep(s, d).withColumn("width", F.col("width") * 10), ["width"], ["n", "overlap"], 2),
    "local_dimension": lambda s, d: _round(se.local_dimension(cloud(s, d).withColumn("bundle", F.lit("all"))), "mean", "std"),
    "calibrated_dimension": lambda s, d: _round(se.calibrated_dimension(_bundles(s, d)), "dimension"),
    "ph_dimension": lambda s, d: _round(se.ph_dimension(cloud(s, d).withColumn("bundle", F.lit("all"))), "dimension", "slope"),
    "magnitude_dimension": lambda s, d: _round(se.magnitude_dimension(_bundles(s, d)), "dimension"),
    "uncertainty_scores": _tu,
    "gram_view": lambda s, d: _round(wt.matrix_view(weights(s, d), "gram_rows"), "v"),
    "gram_cosine": lambda s, d: _round(wt.matrix_view(vw.normalise_rows(weights(s, d), "rows"), "gram_rows"), "v"),
    "gram_correlation": lambda s, d: _round(wt.matrix_view(vw.normalise_rows(weights(s, d), "correlation"), "gram_rows"), "v"),
    "gram_lags": lambda s, d: _round(wt.matrix_view(weights(s, d), "gram_diag"), "v"),
    "flat_view": lambda s, d: _digest(vw.flat(weights(s, d)), "layer_idx"),
    "conv_kernel_view": lambda s, d: _digest(vw.conv_view(kernels(s, d), "kernel"), "layer_idx", "o", "i"),
    "conv_rows_view": lambda s, d: _digest(vw.conv_view(kernels(s, d), "rows"), "layer_idx", "o", "i", "h"),
    "conv_tap_view": lambda s, d: _digest(vw.conv_view(kernels(s, d), "tap"), "layer_idx", "h", "w"),
    "preprocess_unit": lambda s, d: _digest(pp.prepare(_bundles(s, d).select("id", "x"), "l2"), "id"),
    "preprocess_centre": lambda s, d: _digest(pp.prepare(_bundles(s, d).select("id", "x"), "mean_centre"), "id"),
    "preprocess_standardise": lambda s, d: _digest(pp.prepare(_bundles(s, d).select("id", "x"), "standardise"), "id"),
    "preprocess_norm_filter": lambda s, d: pp.prepare(_bundles(s, d).select("id", F.transform("x", lambda v: F.round(v, 4)).alias("x")), ("norm", 60.0, "high")).select("id"),
    "preprocess_dense_part": lambda s, d: pp.prepare(_bundles(s, d).select("id", "x"), ("density", 20, 0.3)).select("id"),
    "global_dimension": lambda s, d: _round(se.global_dimension(_bundles(s, d)), "dimension"),
    "bootstrap_dimension": lambda s, d: _round(se.bootstrap_dimension(_bundles(s, d)), "mean", "std"),
    "geodesic_betti_grid": lambda s, d: _round(geo.betti_grid(_bundles(s, d), [3, 5, 7, 9], 1, 12), "eps"),
    "geodesic_stable_cell": lambda s, d: _round(geo.stable_cell(geo.betti_grid(_bundles(s, d), [3, 4, 5, 6, 7, 8], 0, 12)), "eps"),  # dimension 0 is all that is read
    "geodesic_optimal_k": lambda s, d: geo.optimal_k(_bundles(s, d), list(range(2, 9))),
    "mapper_hdbscan": lambda s, d: mp.cluster_cells(_bundles(s, d).select("id", "x"), mp.cover(lens(s, d).select("id", F.slice("v", 1, 1).alias("v")), 6, 0.3), "hdbscan", min_cluster_size=5).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")),
    "mapper_dbscan_elbow": lambda s, d: mp.cluster_cells(_bundles(s, d).select("id", "x"), mp.cover(lens(s, d).select("id", F.slice("v", 1, 1).alias("v")), 6, 0.3), "dbscan", eps="elbow", min_samples=5).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")),
    "mapper_edges": lambda s, d: mp.node_graph(_nodes(s, d)),
    "mapper_graph_statistics": lambda s, d: _round(mp.graph_statistics(_graph(s, d)), "density", "clustering"),
    "mapper_ph": lambda s, d: mp.graph_diagrams(mp.nerve_edges(mp.cover(lens(s, d), 3, 0.3)).select(F.lit("all").alias("bundle"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("shared").alias("w"))),
    "mapper_hypernetwork_distance": lambda s, d: _compared(s, d, "hypernetwork"),
    "mapper_hypergraph_distance": lambda s, d: _compared(s, d, "hypergraph"),
    "mapper_graph_distance": lambda s, d: _compared(s, d, "graph"),
    "mapper_l2_lens": lambda s, d: mapper_nodes(_bundles(s, d).select("id", "x"), "l2_norm", 8, 0.3, "single", cut=1.1).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")),
    "neuron_cloud": lambda s, d: _digest(neurons(_bundles(s, d).select("bundle", "id", F.transform("x", lambda v: F.round(v, 4)).alias("x")), True), "bundle", "id"),
    "analysis_neural_persistence": lambda s, d: _round(Analysis.from_preset("rieck2019").fit(weights(s, d)).groupBy("bundle").agg(F.sqrt(F.sum(F.when(F.col("death") < float("inf"), F.col("death") * F.col("death")))).alias("norm")), "norm"),
    "analysis_correlation_moments": lambda s, d: _round(Analysis.from_preset("ballester2024").fit(_bundles(s, d)), *(f"{n}_{k}" for k in ("b", "d", "b2", "d2") for n in ("mean", "std"))),
    "analysis_polyhedral": lambda s, d: _round(Analysis.from_preset("liu2023", tool__statistics="suite").fit(_bundles(s, d)), *STATS),
}

_E = "e as (select vec_id id, embedding::double[] x, label::bigint as label from embeddings)"
_W = """w as (select 0 layer_idx, l_suppkey i, l_linenumber::bigint j, round(avg(l_discount - 0.05), 6) + 0.0 w from lineitem group by 2, 3
 union all select 1, l_linenumber::bigint, ascii(l_returnflag)::bigint, round(avg(l_discount - 0.05), 6) + 0.0 from lineitem group by 2, 3)"""
_REL = "p as (select *, greatest(w, 0.0) pos, sum(greatest(w, 0.0)) over (partition by layer_idx, j) s from w), rel as (select layer_idx, i, j, w, case when s > 0 then pos / s else 0.0 end r from p)"
_D = """d as (select event_type bundle, (user_id % 2)::int dim, round(value, 3) birth,
 case when event_id % 50 = 0 then 'inf'::double else round(value, 3) + round((event_id % 7 + 1) * 0.1, 1) end death from events)"""
_F = "f as (select *, death - birth life from d where isfinite(death))"
_TR = "tr as (select dayofyear(ts)::int step, event_type coord, avg(value) v from events group by 1, 2)"
_L = "l as (select vec_id id, round(embedding[1]::double, 6) v0, round(embedding[2]::double, 6) v1, label::bigint as label from embeddings)"
_COVER = f"""{_L}, r as (select min(v0) a0, max(v0) b0, min(v1) a1, max(v1) b1 from l), k as (select unnest(range(5)) c),
 c as (select l.id, x.c || '-' || y.c cell, l.label from l, r, k x, k y
 where v0 between a0 + (b0-a0)/5*(x.c+0.5) - (b0-a0)/5/(1-0.3)/2 and a0 + (b0-a0)/5*(x.c+0.5) + (b0-a0)/5/(1-0.3)/2
 and v1 between a1 + (b1-a1)/5*(y.c+0.5) - (b1-a1)/5/(1-0.3)/2 and a1 + (b1-a1)/5*(y.c+0.5) + (b1-a1)/5/(1-0.3)/2)"""
_NERVE = "g as (select p.cell a, q.cell b, count(*) shared from c p join c q on p.id = q.id and p.cell < q.cell group by 1, 2)"
_NODE = """m as (select count(distinct label) m from l), pc as (select cell, label, count(*) c from c group by 1, 2),
 nd as (select cell, sum(c)::bigint n, count(*) "distinct", arg_min(label, (-c, label)) dominant from pc group by 1)"""
_ONE = f"""{_L}, r as (select min(v0) a0, max(v0) b0 from l), k as (select unnest(range(6)) c), e as (select vec_id id, embedding::double[] x from embeddings),
 c as (select l.id, x.c::varchar cell from l, r, k x where v0 between a0 + (b0-a0)/6*(x.c+0.5) - (b0-a0)/6/(1-0.3)/2 and a0 + (b0-a0)/6*(x.c+0.5) + (b0-a0)/6/(1-0.3)/2)"""


def _knn(k: int, d: str, e: str = _E) -> str:
    return f"""with {e}, p as (select a.id i, b.id j, {d} d from e a, e b where a.id <> b.id),
 q as (select i, j, row_number() over (partition by i order by d, j)::int rank, d from p qualify rank <= {k}) select i, j, rank, round(d, 6) d from q"""


def _forest(edges: str, order: str) -> str:
    """SQL of the forest: an edge is in it if the edges before it don't join its ends.  edges: a select of (bundle, u, v, w)."""
    return f"""fe as materialized ({edges}), fo as materialized (select *, row_number() over (partition by bundle order by w {order}, u, v) k from fe where u <> v),
 fs as materialized (select bundle, u a, v b, k from fo union all select bundle, v, u, k from fo), fr(bundle, k, x) as (select bundle, k, u from fo union select fr.bundle, fr.k, fs.b from fr join fs on fs.bundle = fr.bundle and fs.a = fr.x and fs.k < fr.k),
 tree as materialized (select bundle, u, v, w, k from fo where not exists (select 1 from fr where fr.bundle = fo.bundle and fr.k = fo.k and fr.x = fo.v)),
 node as materialized (select bundle, u x from fe union select bundle, v from fe)"""


_STEP = "case when birth is null then null " + " ".join(f"when birth - {a} <= {b} - birth then {a}" for a, b in zip(_SCHEDULE, _SCHEDULE[1:])) + f" else {_SCHEDULE[-1]} end"
_STEP_D = "case when not isfinite(death) then death " + " ".join(f"when death - {a} <= {b} - death then {a}" for a, b in zip(_SCHEDULE, _SCHEDULE[1:])) + f" else {_SCHEDULE[-1]} end"
_CENTRED = "e as (select vec_id id, list_transform(embedding::double[], lambda v: v - list_avg(embedding::double[])) x from embeddings)"
_COS = "1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))"

_K = """k as (select 0 layer_idx, label::bigint o, q - 1 i, (c - 1) // 8 h, (c - 1) % 8 w, round(v, 4) v from (select label, row_number() over (partition by label order by vec_id) q, embedding from embeddings) t,
 lateral (select generate_subscripts(t.embedding, 1) c, unnest(t.embedding)::double v))"""
_U = "u as (select vec_id id, generate_subscripts(embedding, 1) c, unnest(embedding)::double v from embeddings)"
_E8 = "e as (select vec_id id, embedding::double[] x from embeddings)"

_NET = f"select 'all' bundle, 'a' || layer_idx || '-' || i u, 'a' || (layer_idx + 1) || '-' || j v, abs(w) w from w"
_MERGED = "select bundle, 0.0::double birth, round((select max(w) from fe where fe.bundle = tree.bundle) - w, 6) + 0.0 death from tree union all select bundle, 0.0, 'inf'::double from (select bundle, unnest(range(n)) from (select node.bundle, count(*) - (select count(*) from tree where tree.bundle = node.bundle) n from node group by 1))"

ORACLE_SQL: dict[str, str] = {
    "superlevel_h0": f"with recursive {_W}, {_forest(_NET, 'desc')} {_MERGED}",
    "uncertainty_scores": f"""with recursive {_W}, li as (select l_suppkey % 50 sample, l_suppkey s, l_linenumber::bigint n, l_quantity q from lineitem), ac as (select sample, 0 layer_idx, s i, avg(q) a from li group by 1, 3 union all select sample, 1, n, avg(q) from li group by 1, 3),
 {_forest("select sample || '/' || ac.layer_idx bundle, 'a' || ac.i u, 'b' || j v, abs(w * a) w from ac join w on w.layer_idx = ac.layer_idx and w.i = ac.i", 'desc')},
 dg as (select split_part(bundle, '/', 1)::bigint sample, split_part(bundle, '/', 2)::int l, w x, row_number() over (partition by bundle order by w desc) pos from tree), mn as (select sample % 3 c, l, pos, avg(x) m from dg group by 1, 2, 3),
 ly as (select sample, dg.l, sqrt(avg((x - m) ** 2)) r from dg join mn on mn.c = sample % 3 and mn.l = dg.l and mn.pos = dg.pos group by 1, 2) select sample, round(avg(r), 6) score from ly group by 1""",
    "knn_graph_h0": f"""with recursive {_E}, p as (select a.id i, b.id j, list_distance(a.x, b.x) d from e a, e b where a.id <> b.id), q as (select i, j, d from p qualify row_number() over (partition by i order by d, j) <= 5),
 {_forest("select distinct 'all' bundle, least(i, j) u, greatest(i, j) v, round(d, 6) w from q", '')}, left_ as (select (select count(*) from node) - (select count(*) from tree) n)
 select bundle, 0 dim, 0.0::double birth, round(w, 6) death from tree union all select 'all', 0, 0.0, 'inf'::double from (select unnest(range(n)) from left_)""",
    "two_nn_id": f"""with {_E}, p as (select a.id i, b.id j, list_distance(a.x, b.x) d from e a, e b where a.id <> b.id),
 r as (select i, d, row_number() over (partition by i order by d, j) rn from p qualify rn <= 2), m as (select i, max(case when rn = 1 then d end) r1, max(case when rn = 2 then d end) r2 from r group by i)
 select count(*) n, round(exp(-0.5772156649015329 - avg(ln(ln(r2 / r1)))), 6) id from m where r1 > 0 and r2 > r1""",
    "knn_topk": _knn(5, "list_distance(a.x, b.x)"),
    "nearest_cosine": _knn(1, _COS),
    "nearest_cityblock": _knn(1, "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))"),
    "nearest_correlation": _knn(1, _COS, _CENTRED),
    "vne_nearest": _knn(1, "list_distance(a.x, b.x)", """s as (select c, stddev_pop(v) sd from (select generate_subscripts(embedding, 1) c, unnest(embedding)::double v from embeddings) group by 1),
 e as (select u.vec_id id, list(u.v / case when sd = 0 then 1 else sd end order by u.c) x from (select vec_id, generate_subscripts(embedding, 1) c, unnest(embedding)::double v from embeddings) u join s on s.c = u.c group by 1)"""),
    "pairs_within": f"with {_E} select a.id i, b.id j, round(list_distance(a.x, b.x), 6) d from e a, e b where a.id < b.id and list_distance(a.x, b.x) <= 1.1",
    "density_filter": f"""with {_E}, p as (select a.id i, b.id j, list_distance(a.x, b.x) d from e a, e b where a.id <> b.id), q as (select i, d, row_number() over (partition by i order by d, j) rk from p qualify rk <= 10),
 g as (select i id, 1 / avg(d) density from q group by 1) select id, round(density, 6) density from g where density >= (select quantile_cont(density, 0.25) from g)""",
    "labelled_vertices": f"""with {_E}, g as (select a.id, min(list_distance(a.x, b.x)) gap from e a, e b where a.label = 0 and b.label <> 0 group by 1)
 select id, round(gap, 6) gap from g where gap <= (select quantile_cont(gap, 0.5) from g)""",
    "activation_patterns": "select list_aggregate(list_transform(embedding, lambda v: (v > 0)::int::varchar), 'string_agg', '') pattern, min(vec_id) first_id, count(*) n from embeddings group by 1",
    "predicted_labels": "select vec_id id, list_position(embedding, list_max(embedding)) - 1 as label from embeddings",
    "relevance_edges": f"with {_W}, {_REL} select layer_idx, i, j, w, round(r, 6) r from rel",
    "normalized_edges": f"with {_W} select layer_idx, i, j, w, round(abs(w) / max(abs(w)) over (partition by layer_idx), 6) r from w",
    "induced_paths": f"""with {_W}, {_REL} select layer_idx from_layer, layer_idx + 1 to_layer, i, j k, round(r, 6) r from rel
 union all select 0, 2, a.i, b.j, round(max(a.r * b.r), 6) from rel a join rel b on a.layer_idx = 0 and b.layer_idx = 1 and a.j = b.i group by a.i, b.j""",
    "gram_view": f"with {_W} select a.layer_idx, a.i a, b.i b, round(sum(a.w * b.w), 6) + 0.0 v from w a join w b on a.layer_idx = b.layer_idx and a.j = b.j and a.i <= b.i group by 1, 2, 3",
    "row_norms": f"with {_W} select layer_idx, i n, round(sqrt(sum(w * w)), 6) v from w group by 1, 2",
    "weight_norms": f"with {_W} select layer_idx, round(sqrt(sum(w * w)), 6) fro, round(sum(abs(w)), 6) l1, round(max(abs(w)), 6) max_abs, count(*) filter (w = 0) zeros from w group by 1",
    "magnitude_mask": f"""with {_W}, n as (select round_even(count(*) * 0.4, 0)::bigint k from w), t as (select abs(w) cut from w order by 1 limit 1 offset (select k - 1 from n)),
 c as (select layer_idx, j, count(*) n, count(*) filter (abs(w) > (select cut from t)) kept from w group by 1, 2)
 select layer_idx, sum(n)::bigint n, sum(kept)::bigint kept, count(*) filter (kept = 0) dead from c group by 1""",
    "diagram_statistics": f"""with {_D}, {_F}, t as (select *, sum(life) over w total, row_number() over (partition by bundle, dim order by life, birth) i, avg(life) over w mu from f where life > 0 window w as (partition by bundle, dim))
 select bundle, dim, count(*) n, round(sum(life), 6) total_persistence, round(sqrt(sum(life * life)), 6) persistence_norm, round(-sum(life / total * ln(life / total)), 6) entropy, round(avg(life), 6) mean,
 round(median(life), 6) median, round(max(life), 6) max, round(min(life), 6) min, round(stddev_pop(life), 6) std, round(2 * sum(i * life) / (count(*) * sum(life)) - (count(*) + 1) / count(*), 6) gini,
 round(max(life) / sum(life), 6) top1, round(avg((life - mu) ** 3) / stddev_pop(life) ** 3, 6) skew, round(avg(birth), 6) birth_mean, round(max(birth), 6) birth_max from t group by 1, 2""",
    "diagram_moments": f"""with {_D}, {_F} select bundle, dim, round(avg(birth), 6) mean_b, round(stddev_pop(birth), 6) std_b, round(avg(death), 6) mean_d, round(stddev_pop(death), 6) std_d,
 round(avg(birth * birth), 6) mean_b2, round(stddev_pop(birth * birth), 6) std_b2, round(avg(death * death), 6) mean_d2, round(stddev_pop(death * death), 6) std_d2 from f group by 1, 2""",
    "betti_number": f"with {_D} select bundle, dim, count(*) filter (birth <= 10 and death >= 10) betti from d group by 1, 2",
    "betti_curve": f"""with {_D}, r as (select bundle, dim, min(birth) lo, max(death) filter (isfinite(death)) hi from d group by 1, 2),
 g as (select bundle, dim, step, lo + (hi - lo) * step / 19 t from r, (select unnest(range(20))::int step))
 select g.bundle, g.dim, step, round(t, 6) t, count(*) filter (birth <= t and death >= t) betti from g join d on g.bundle = d.bundle and g.dim = d.dim group by 1, 2, 3, t""",
    "landscape_topk": f"""with {_D}, {_F}, r as (select bundle, dim, min(birth) lo, max(death) hi from f group by 1, 2), g as (select *, lo + (hi - lo) * step / 9 t from r, (select unnest(range(10))::int step)),
 x as (select f.bundle, f.dim, step, greatest(0.0, least(t - birth, death - t)) v, birth, death from f join g on f.bundle = g.bundle and f.dim = g.dim),
 y as (select bundle, dim, step, row_number() over (partition by bundle, dim, step order by v desc, birth, death)::int level, v from x qualify level <= 3) select bundle, dim, step, level, round(v, 6) "value" from y""",
    "persistence_image": f"""with {_D}, {_F}, r as (select bundle, dim, min(birth) b0, max(birth) b1, max(life) l1 from f group by 1, 2), k as (select unnest(range(4))::int k),
 g as (select r.*, x.k px, y.k py from r, k x, k y) select f.bundle, f.dim, px, py, round(sum(life * exp(-((birth - (b0 + (b1 - b0) * px / 3)) ** 2 + (life - l1 * py / 3) ** 2) / 50.0)), 6) "value"
 from f join g on f.bundle = g.bundle and f.dim = g.dim group by 1, 2, 3, 4""",
    "snap_diagram": f"with {_D} select bundle, dim, ({_STEP})::double birth, ({_STEP_D})::double death, count(*) n from d group by 1, 2, 3, 4",
    "diagram_multiplicity": f"with {_D} select bundle, dim, birth, death, count(*) n, round(log10(1 + count(*)), 6) log_n from d group by 1, 2, 3, 4",
    "barcode_longest": f"with {_D}, {_F}, x as (select *, row_number() over (partition by bundle, dim order by life desc, birth) k from f qualify k <= 5) select bundle, dim, round(sum(life), 6) life from x group by 1, 2",
    "betti0_at_eps": f"""with recursive {_E}, q as (select unnest([1.1, 1.2, 1.3])::double eps), g as materialized (select eps, a.label, a.id i, b.id j from e a, e b, q where a.label = b.label and list_distance(a.x, b.x) <= eps),
 r(eps, label, root, i) as (select eps, label, id, id from e, q union select r.eps, r.label, r.root, g.j from r join g on g.eps = r.eps and g.i = r.i),
 m as (select eps, label, i, min(root) c from r group by 1, 2, 3) select label::varchar bundle, eps, count(distinct c) b0 from m group by 1, 2""",
    "cover_cells": f"with {_COVER} select cell, count(*) n, sum(id)::bigint ids from c group by 1",
    "nerve_edges": f"with {_COVER}, {_NERVE} select * from g",
    "nerve_betti": f"""with recursive {_COVER}, {_NERVE}, n as materialized (select distinct cell from c), s as materialized (select a, b from g union all select b, a from g),
 t(root, cell) as (select cell, cell from n union select t.root, s.b from t join s on s.a = t.cell), m as (select cell, min(root) z from t group by 1), x as (select (select count(*) from n) nodes, (select count(*) from g) edges, count(distinct z) b0 from m)
 select nodes, edges, b0, edges - nodes + b0 b1 from x""",
    "node_diversity": f"with {_COVER}, {_NODE} select cell, n, \"distinct\", dominant, round(\"distinct\" / (m * (1 - (1 - 1 / m) ** n)), 6) diversity from nd, m",
    "class_separation": f"""with {_COVER}, {_NERVE}, {_NODE} select count(*) edges, count(*) filter (x.dominant <> y.dominant) mixed, round(count(*) filter (x.dominant <> y.dominant) / count(*), 6) score
 from g join nd x on g.a = x.cell join nd y on g.b = y.cell""",
    "node_exemplars": f"""with {_ONE}, u as (select c.cell, c.id, generate_subscripts(e.x, 1) k, unnest(e.x) v from c join e on c.id = e.id), z as (select cell, k, avg(v) m from u group by 1, 2),
 d as (select u.cell, u.id, round(sum((v - m) ** 2), 9) d2 from u join z on u.cell = z.cell and u.k = z.k group by 1, 2) select cell, row_number() over (partition by cell order by d2, id)::int rank, id from d qualify rank <= 3""",
    "trajectory_distance": f"with {_TR} select a.step a, b.step b, round(sqrt(sum((a.v - b.v) ** 2)), 6) d from tr a join tr b on a.coord = b.coord and a.step < b.step group by 1, 2",
    "trajectory_loss_difference": f"with {_TR} select a.step a, b.step b, round(avg(abs(a.v - b.v)), 6) d from tr a join tr b on a.coord = b.coord and a.step < b.step group by 1, 2",
    "trajectory_smooth": f"""with {_TR}, i as (select *, row_number() over (partition by coord order by step) i, count(*) over (partition by coord) n from tr), k as (select unnest([-2, -1, 0, 1, 2]) k)
 select a.step, a.coord "key", round(a.v, 6) v, round(avg(b.v), 6) s from i a, k join i b on true where b.coord = a.coord and b.i = greatest(1, least(a.n, a.i + k)) group by 1, 2, a.v""",
    "rolling_steps": f"""with {_TR}, p as (select step, dense_rank() over (order by step) - 1 i from (select distinct step from tr)), w as (select unnest(range(0, (select max(i) + 1 from p) - 9, 5)) win)
 select win, count(*) n, round(avg(v), 6) mean from w, p, tr where p.i between win and win + 9 and tr.step = p.step group by 1""",
    "grid_expand": f"""with {_L}, r as (select min(v0) lo, max(v0) hi from l), a as (select unnest(range(3)) i, unnest([4, 6, 8])::bigint n), b as (select unnest(range(4)) j, unnest([0.2, 0.3, 0.4, 0.5])::double overlap)
 select (i * 4 + j)::int ordinal, n, overlap, round((hi - lo) / n / (1 - overlap), 6) width from a, b, r""",
    "plateaus": f"""with {_L}, r as (select min(v0) lo, max(v0) hi from l), a as (select unnest([4, 6, 8])::bigint n), b as (select unnest([0.2, 0.3, 0.4, 0.5])::double overlap),
 x as (select n, overlap, round(round((hi - lo) / n / (1 - overlap), 6) * 10, 0) width from a, b, r) select width, count(*) n, string_agg(distinct n::varchar, ',' order by n::varchar) n_span, string_agg(distinct overlap::varchar, ',' order by overlap::varchar) overlap_span
 from x group by 1 having count(*) >= 2""",
    "gram_cosine": f"""with {_W}, u as (select layer_idx, i, j, w / (sqrt(sum(w * w) over (partition by layer_idx, i)) + 1e-12) w from w)
 select a.layer_idx, a.i a, b.i b, round(sum(a.w * b.w), 6) + 0.0 v from u a join u b on a.layer_idx = b.layer_idx and a.j = b.j and a.i <= b.i group by 1, 2, 3""",
    "gram_correlation": f"""with {_W}, m as (select layer_idx, i, j, w - avg(w) over (partition by layer_idx, i) w from w),
 u as (select layer_idx, i, j, w / (sqrt(sum(w * w) over (partition by layer_idx, i)) + 1e-12) w from m)
 select a.layer_idx, a.i a, b.i b, round(sum(a.w * b.w), 6) + 0.0 v from u a join u b on a.layer_idx = b.layer_idx and a.j = b.j and a.i <= b.i group by 1, 2, 3""",
    "gram_lags": f"""with {_W}, g as (select a.layer_idx, a.i a, b.i b, sum(a.w * b.w) v from w a join w b on a.layer_idx = b.layer_idx and a.j = b.j and a.i <= b.i group by 1, 2, 3)
 select layer_idx, b - a lag, round(avg(v), 6) + 0.0 v from g group by 1, 2""",
    "flat_view": f"with {_W}, r as (select layer_idx, w, row_number() over (partition by layer_idx order by i, j) p from w) select layer_idx, count(*) dims, round(sum(w * p), 5) + 0.0 mix from r group by 1",
    "conv_kernel_view": f"with {_K} select layer_idx, o, i, count(*) dims, round(sum(v * (h * 8 + w + 1)), 5) + 0.0 mix from k group by 1, 2, 3",
    "conv_rows_view": f"with {_K} select layer_idx, o, i, h, count(*) dims, round(sum(v * (w + 1)), 5) + 0.0 mix from k group by 1, 2, 3, 4",
    "conv_tap_view": f"with {_K}, r as (select *, row_number() over (partition by h, w order by o, i) q from k) select layer_idx, h, w, count(*) dims, round(sum(v * q), 5) + 0.0 mix from r group by 1, 2, 3",
    "preprocess_unit": f"with {_U} select id, count(*) dims, round(sum(v * c) / (sqrt(sum(v * v)) + 1e-12), 5) + 0.0 mix from u group by 1",
    "preprocess_centre": f"with {_U}, m as (select id, c, v - avg(v) over (partition by c) v from u) select id, count(*) dims, round(sum(v * c), 5) + 0.0 mix from m group by 1",
    "preprocess_standardise": f"with {_U}, m as (select id, c, (v - avg(v) over (partition by c)) / (stddev_pop(v) over (partition by c) + 1e-12) v from u) select id, count(*) dims, round(sum(v * c), 5) + 0.0 mix from m group by 1",
    "preprocess_norm_filter": f"with {_U}, n as (select id, sqrt(sum(round(v, 4) ** 2)) n from u group by 1) select id from n where n >= (select quantile_cont(n, 0.6) from n)",
    "preprocess_dense_part": f"""with {_E8}, p as (select a.id, list_distance(a.x, b.x) d from e a, e b), q as (select id, d from p qualify row_number() over (partition by id order by d) = 20)
 select id from q qualify row_number() over (order by d, id) <= (select round_even(0.3 * count(*), 0) from e)""",
    "global_dimension": f"""with {_E}, p as (select a.label, a.id i, list_distance(a.x, b.x) d from e a, e b where a.id <> b.id and a.label = b.label), r as (select label, i, d, row_number() over (partition by i order by d) rn from p qualify rn <= 2),
 m as (select label, i, max(case when rn = 1 then d end) r1, max(case when rn = 2 then d end) r2 from r group by 1, 2)
 select label::varchar bundle, count(*) n, round(exp(-0.5772156649015329 - avg(ln(ln(r2 / r1))) filter (r1 > 0 and r2 > r1)), 6) dimension from m group by 1""",
    "neuron_cloud": """with u as (select label::varchar bundle, vec_id s, generate_subscripts(embedding, 1) c, round(unnest(embedding)::double, 4) v from embeddings),
 k as (select bundle, c from u group by 1, 2 having var_pop(v) > 1e-12), r as (select u.bundle, u.c, v, row_number() over (partition by u.bundle, u.c order by s) q from u join k on u.bundle = k.bundle and u.c = k.c)
 select bundle, (c - 1)::bigint id, count(*) dims, round(sum(v * q), 5) + 0.0 mix from r group by 1, 2""",
}


def _more() -> None:
    from . import more_queries

    QUERIES.update(more_queries.QUERIES)
    ORACLE_SQL.update(more_queries.ORACLE_SQL)


_more()
