"""Topological uncertainty: spanning-tree diagrams of |W x| against the mean diagram of each class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import Union


def tree_diagrams(weights: DataFrame, activations: DataFrame) -> DataFrame:
    """(sample, layer_idx, pos, v): sorted edge values of the maximum spanning tree of |w_ij a_i| for each sample (sample, layer_idx, i, a)."""
    edges = activations.join(weights, ["layer_idx", "i"]).select("sample", "layer_idx", "i", "j", F.abs(F.col("w") * F.col("a")).alias("v"))

    def run(key, t):
        i, j, v = (t[c].to_numpy() for c in ("i", "j", "v"))
        name = {x: k for k, x in enumerate(sorted({(0, int(a)) for a in i} | {(1, int(b)) for b in j}))}
        u, out = Union(len(name)), []
        for k in np.lexsort((j, i, -v)).tolist():
            if u.join(name[(0, int(i[k]))], name[(1, int(j[k]))]):
                out.append(float(v[k]))
        return pa.table({"sample": pa.array([key[0].as_py()] * len(out), pa.int64()), "layer_idx": pa.array([key[1].as_py()] * len(out), pa.int32()), "pos": pa.array(range(len(out)), pa.int32()), "v": pa.array(out, pa.float64())})

    return edges.groupBy("sample", "layer_idx").applyInArrow(run, "sample long, layer_idx int, pos int, v double")


def class_means(diagrams: DataFrame, labels: DataFrame) -> DataFrame:
    """(layer_idx, label, pos, s, n): sums and counts, so parts of the data can be added up later."""
    return diagrams.join(labels.select("sample", "label"), "sample").groupBy("layer_idx", "label", "pos").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))


def merge_means(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("layer_idx", "label", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def scores(diagrams: DataFrame, labels: DataFrame, means: DataFrame) -> DataFrame:
    """(sample, score): mean over layers of the root mean square distance to the mean diagram of the sample's class; an unseen class has a zero diagram."""
    m = means.select("layer_idx", "label", "pos", (F.col("s") / F.col("n")).alias("m"))
    d = diagrams.join(labels.select("sample", "label"), "sample").join(m, ["layer_idx", "label", "pos"], "left")
    layer = d.groupBy("sample", "layer_idx").agg(F.sqrt(F.avg(F.pow(F.col("v") - F.coalesce("m", F.lit(0.0)), F.lit(2)))).alias("r"))
    return layer.groupBy("sample").agg(F.avg("r").alias("score"))
