"""Measures over training: a value, or a distance between diagrams, for each recorded step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import bottleneck, wasserstein
from . import diagrams as dg, series as se


def activation_statistics(activations: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean, std, sparsity, max) of activations (keys, a): population deviation, share of exact zeros, largest magnitude."""
    a = F.col("a")
    return activations.groupBy(*keys).agg(F.avg(a).alias("mean"), F.stddev_pop(a).alias("std"), F.avg((a == 0).cast("double")).alias("sparsity"), F.max(F.abs(a)).alias("max"))


def spectral_norms(weights: DataFrame, *keys: str) -> DataFrame:
    """(keys, l2, nuc): largest singular value and sum of them, of each matrix (keys, i, j, w); absent entries are 0.

    A matrix's smaller Gram matrix is summed up by Spark, so a task holds its shorter side squared, never the matrix.
    """
    keys = list(keys)
    size = weights.groupBy(*keys).agg(F.count_distinct("i").alias("_m"), F.count_distinct("j").alias("_n"))
    w = weights.join(size, keys)
    own, other = F.when(F.col("_m") <= F.col("_n"), F.col("i")).otherwise(F.col("j")), F.when(F.col("_m") <= F.col("_n"), F.col("j")).otherwise(F.col("i"))
    w = w.select(*keys, own.alias("a"), other.alias("_o"), "w")
    gram = w.join(w.select(*keys, F.col("a").alias("b"), "_o", F.col("w").alias("_w")), [*keys, "_o"]).filter("a <= b").groupBy(*keys, "a", "b").agg(F.sum(F.col("w") * F.col("_w")).alias("v"))

    def run(key, t):
        a, b, v = (t[c].to_numpy() for c in ("a", "b", "v"))
        names = np.unique(np.r_[a, b])
        i, j = np.searchsorted(names, a), np.searchsorted(names, b)
        g = np.zeros((len(names), len(names)))
        g[i, j] = g[j, i] = v
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(g), 0))
        return pa.table({**{k: pa.array([x.as_py()], t.schema.field(k).type) for k, x in zip(keys, key)}, "l2": pa.array([float(s.max())]), "nuc": pa.array([float(s.sum())])})

    kinds = ", ".join(f"{k} {weights.schema[k].dataType.simpleString()}" for k in keys)
    return gram.groupBy(*keys).applyInArrow(run, f"{kinds}, l2 double, nuc double")


def scale_normalised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (bundle, u, v, w; each pair once) over the mean magnitude off the diagonal, pairs without an edge counting as 0; a bundle of only zeros stays.

    nodes (bundle, n): how many nodes each bundle has.
    """
    total = edges.filter("u <> v").groupBy("bundle").agg(F.sum(F.abs("w")).alias("_s")).join(nodes, "bundle")
    scale = total.select("bundle", (2 * F.col("_s") / (F.col("n") * (F.col("n") - 1))).alias("_m"))
    return edges.join(scale, "bundle", "left").withColumn("w", F.when(F.col("_m") > 0, F.col("w") / F.col("_m")).otherwise(F.col("w"))).drop("_m")


def step_pairs(steps: DataFrame, how: str) -> DataFrame:
    """(a, b) of steps to compare: final, initial or previous (b is the step, a its reference), or all (a < b)."""
    s = steps.select("step").distinct()
    order = Window.orderBy("step")  # over steps of training, not over data
    if how == "all":
        return s.select(F.col("step").alias("a")).join(s.select(F.col("step").alias("b")), F.col("a") < F.col("b"))
    if how == "previous":
        return s.select(F.lag("step").over(order).alias("a"), F.col("step").alias("b")).dropna()
    if how in ("final", "initial"):
        end = s.agg((F.max if how == "final" else F.min)("step").alias("a"))
        return s.select(F.col("step").alias("b")).join(F.broadcast(end)).select("a", "b")  # one row
    raise ValueError(f"unknown reference {how!r}")


def diagram_distances(diagrams: DataFrame, how: str = "previous", order: float = 1.0) -> DataFrame:
    """(dim, a, b, wasserstein, bottleneck) between the finite parts of the diagrams (step, dim, birth, death) of pairs of steps.

    NaN if either has no finite bar.  A diagram travels once for each pair it is in.
    """
    bars = dg.finite(diagrams.withColumn("bundle", F.col("step"))).groupBy("step", "dim").agg(F.array_sort(F.collect_list(F.struct("birth", "death"))).alias("bars"))
    pairs = step_pairs(diagrams, how).join(diagrams.select("dim").distinct())
    x = pairs.join(bars.withColumnsRenamed({"step": "a", "bars": "p"}), ["a", "dim"], "left").join(bars.withColumnsRenamed({"step": "b", "bars": "q"}), ["b", "dim"], "left")

    def run(batches):
        for t in batches:
            rows = []
            for p, q in zip(t["p"].to_pylist(), t["q"].to_pylist()):
                p, q = (np.array([(b["birth"], b["death"]) for b in z or []], float).reshape(-1, 2) for z in (p, q))
                rows.append((wasserstein(p, q, order), bottleneck(p, q)) if len(p) and len(q) else (float("nan"),) * 2)
            yield pa.record_batch({"dim": t["dim"], "a": t["a"], "b": t["b"], "wasserstein": pa.array([r[0] for r in rows], pa.float64()), "bottleneck": pa.array([r[1] for r in rows], pa.float64())})

    kinds = {c: diagrams.schema[c].dataType.simpleString() for c in ("step", "dim")}
    return x.select("dim", "a", "b", "p", "q").mapInArrow(run, f"dim {kinds['dim']}, a {kinds['step']}, b {kinds['step']}, wasserstein double, bottleneck double")


def trajectory_measures(data: DataFrame, analyse: Callable[[DataFrame], DataFrame], measures: list[str], series: str | None = None) -> DataFrame:
    """(epoch, measure, series, value): an analysis of every snapshot in one query.

    data: the analysis's input with a column step, and one named by series if snapshots fall
    into several (layers, say).  analyse takes the table with a column bundle and returns one
    with bundle and the measures.  A snapshot of which nothing comes has NaN.
    """
    keys = data.select(F.col("step"), (F.col(series).cast("string") if series else F.lit("all")).alias("series")).distinct()
    name = F.concat_ws("/", F.col("step").cast("string"), F.col(series).cast("string") if series else F.lit("all"))
    found = analyse(data.withColumn("bundle", name))
    long = found.select(F.col("bundle").cast("string").alias("bundle"), F.posexplode(F.array(*[F.col(m).cast("double") for m in measures])).alias("_m", "value"))
    label = F.element_at(F.array(*[F.lit(m) for m in measures]), F.col("_m") + 1)
    spine = keys.withColumn("_m", F.explode(F.array(*[F.lit(k) for k in range(len(measures))]))).withColumn("bundle", F.concat_ws("/", F.col("step").cast("string"), "series"))
    return spine.join(long, ["bundle", "_m"], "left").select(F.col("step").alias("epoch"), label.alias("measure"), "series", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def windowed_dimension(trajectory: DataFrame, window: int, stride: int = 1, how: str = "ph") -> DataFrame:
    """(win, centre, dimension) of the points that a trajectory (step, coord, v) passes in each window of so many steps.

    how: ph, magnitude or two_nn.  centre is the step in the middle of the window; a window
    of which no dimension can be had has NaN.
    """
    own = se.rolling_groups(trajectory, window, stride)
    points = own.groupBy("win", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("coord", "v"))), lambda s: s["v"]).alias("x"))
    points = points.select(F.col("win").cast("string").alias("bundle"), F.col("step").cast("long").alias("id"), "x")
    kind = {"ph": se.ph_dimension, "magnitude": se.magnitude_dimension, "two_nn": se.global_dimension}[how]
    middle = points.groupBy("bundle").agg(F.element_at(F.array_sort(F.collect_list("id")), window // 2 + 1).alias("centre"))
    return kind(points).join(middle, "bundle").select(F.col("bundle").cast("long").alias("win"), "centre", "dimension")
