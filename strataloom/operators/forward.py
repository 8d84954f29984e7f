"""Layered networks as tables: masks, products in blocks, activations, accuracy.

Inputs are (sample, i, a), weights (layer_idx, i, j, w), biases (layer_idx, j, b).  A layer is
a join of blocks of inputs with blocks of weights on the neurons they share, a product in
each pair of blocks, and a sum of what falls on one block of outputs; no task holds a layer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Samples and neurons of a block.
BLOCK = 512

ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda z: z, "relu": lambda z: F.greatest(z, F.lit(0.0)), "tanh": F.tanh, "sigmoid": lambda z: 1 / (1 + F.exp(-z)),
}


def apply_masks(weights: DataFrame, masks: DataFrame) -> DataFrame:
    """weights with 0 where masks (layer_idx, i, j, kept) says that a weight isn't kept; weights without a row there stay."""
    m = masks.select("layer_idx", "i", "j", F.col("kept").alias("_kept"))
    return weights.join(m, ["layer_idx", "i", "j"], "left").withColumn("w", F.when(F.coalesce("_kept", F.lit(True)), F.col("w")).otherwise(0.0)).drop("_kept")


def _blocked(df: DataFrame, row: str, col: str, value: str, block: int, names: tuple[str, str, str]) -> DataFrame:
    """Blocks of a matrix table as lists of entries: names of the row block, the column block and the entries (struct of r, c, v)."""
    at = lambda c: F.expr(f"{c} div {block}")
    return df.groupBy(at(row).alias(names[0]), at(col).alias(names[1])).agg(F.collect_list(F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).alias("v"))).alias(names[2]))


def _product(batches):
    """Rows (sample, j, z) of the products of a block of inputs and a block of weights."""
    for t in batches:
        for a, w in zip(t.column(0), t.column(1)):
            left, right = (pa.RecordBatch.from_struct_array(x.values) for x in (a, w))
            s, i, x = (left.column(k).to_numpy() for k in range(3))
            i2, j, y = (right.column(k).to_numpy() for k in range(3))
            samples, ps = np.unique(s, return_inverse=True)
            shared, pi = np.unique(i, return_inverse=True)
            outs, pj = np.unique(j, return_inverse=True)
            m, n = np.zeros((len(samples), len(shared))), np.zeros((len(shared), len(outs)))
            np.add.at(m, (ps, pi), x)
            at = np.minimum(np.searchsorted(shared, i2), len(shared) - 1)
            ok = shared[at] == i2
            np.add.at(n, (at[ok], pj[ok]), y[ok])
            z = m @ n
            yield pa.record_batch({"sample": pa.array(np.repeat(samples, len(outs))), "j": pa.array(np.tile(outs, len(samples))), "z": pa.array(z.reshape(-1))})


def layer(inputs: DataFrame, weights: DataFrame, biases: DataFrame | None = None, activation: str = "relu", block: int = BLOCK) -> DataFrame:
    """(sample, i, a): outputs of a layer of weights (i, j, w), and biases (j, b) if there are any, for inputs (sample, i, a); absent inputs and weights are 0."""
    a = _blocked(inputs.select("sample", "i", F.col("a").cast("double").alias("a")), "sample", "i", "a", block, ("sb", "ib", "left"))
    w = _blocked(weights.select("i", "j", F.col("w").cast("double").alias("w")), "i", "j", "w", block, ("ib", "jb", "right"))
    parts = a.join(w, "ib").select("left", "right").mapInArrow(_product, "sample long, j long, z double")
    z = parts.groupBy("sample", "j").agg(F.sum("z").alias("z"))
    if biases is not None:
        z = z.join(biases.select("j", "b"), "j", "left").withColumn("z", F.col("z") + F.coalesce("b", F.lit(0.0)))
    return z.select("sample", F.col("j").alias("i"), ACTIVATIONS[activation](F.col("z")).alias("a"))


def forward(inputs: DataFrame, weights: DataFrame, layers: list[int], biases: DataFrame | None = None, activation: str = "relu", last: str = "linear", block: int = BLOCK) -> DataFrame:
    """(sample, i, a): what the last of the layers puts out; every layer but the last is activated."""
    out = inputs.select("sample", "i", "a")
    for k in layers:
        own = None if biases is None else biases.filter(F.col("layer_idx") == k)
        out = layer(out, weights.filter(F.col("layer_idx") == k), own, last if k == layers[-1] else activation, block)
    return out


def accuracy(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (n, correct, accuracy): samples whose largest output (ties: the first) is their label (sample, label)."""
    best = outputs.groupBy("sample").agg(F.min_by("i", F.struct(-F.col("a"), F.col("i"))).alias("i"))
    hit = best.join(labels.select("sample", "label"), "sample").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == F.col("label")).alias("correct"))
    return hit.withColumn("accuracy", F.try_divide("correct", "n"))


def pruned_accuracy(inputs: DataFrame, labels: DataFrame, weights: DataFrame, masks: DataFrame | None, layers: list[int], biases: DataFrame | None = None, activation: str = "relu") -> DataFrame:
    """accuracy() of a network with or without masks."""
    w = weights if masks is None else apply_masks(weights, masks)
    return accuracy(forward(inputs, w, layers, biases, activation), labels)
