"""Preparing clouds (id, x): scaling, centring, and filters by density or norm."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import written
from .mapper import codensity
from .points import standardise

_GUARD = 1e-12


def _norm():
    return F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))


def unit(points: DataFrame) -> DataFrame:
    """Points of length one; a zero point stays."""
    return points.withColumn("_n", _norm() + _GUARD).withColumn("x", F.transform("x", lambda v: v / F.col("_n"))).drop("_n")


def centre(points: DataFrame) -> DataFrame:
    """Points less the mean of each coordinate."""
    long = points.select("id", F.posexplode("x").alias("c", "v"))
    mean = long.groupBy("c").agg(F.avg("v").alias("m"))
    means = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda s: s["m"]).alias("_m"))
    return points.join(F.broadcast(means)).withColumn("x", F.zip_with("x", "_m", lambda v, m: v - m)).drop("_m")  # one row


def norm_filter(points: DataFrame, q: float = 50.0, side: str = "high") -> DataFrame:
    """Points whose norm is at least (high) or at most (low) the q-th percentile."""
    own = points.withColumn("_n", _norm())
    cut = own.agg(F.percentile("_n", F.lit(q / 100)).alias("_c"))
    keep = F.col("_n") >= F.col("_c") if side == "high" else F.col("_n") <= F.col("_c")
    return own.join(F.broadcast(cut)).filter(keep).drop("_n", "_c")  # one row


def dense_part(points: DataFrame, k: int = 200, share: float = 0.5) -> DataFrame:
    """The share of points with the smallest codensity: distance to the k-th neighbour."""
    n = points.count()
    v = written(codensity(points, k), "codensity")
    keep = max(1, round(share * n))
    cut = _kth(v, keep)
    at = v.join(F.broadcast(cut))  # one row
    inside = at.filter("v < cut").select("id")
    # Ties at the cut go by id; only they are ordered.
    more = at.filter("v = cut").orderBy("id").select("id", "below").withColumn("r", F.row_number().over(Window.orderBy("id"))).filter(F.col("r") + F.col("below") <= keep).select("id")
    return points.join(inside.unionByName(more), "id", "left_semi")


def _kth(v: DataFrame, k: int) -> DataFrame:
    """One row (cut, below): the k-th smallest v and how many are less."""
    n = v.count()
    cut = v.agg(F.percentile("v", F.lit((k - 1) / max(1, n - 1))).alias("p"))
    near = v.join(F.broadcast(cut)).agg(F.min_by("v", F.abs(F.col("v") - F.col("p"))).alias("cut"))
    return v.join(F.broadcast(near)).groupBy("cut").agg(F.count_if(F.col("v") < F.col("cut")).alias("below"))


def prepare(points: DataFrame, steps: str | tuple | list | None) -> DataFrame:
    """steps in order: "l2", "mean_centre", "standardise", ("density", k, share), ("norm", q, side) or a function of the table."""
    if steps is None:
        return points
    if isinstance(steps, list):
        for s in steps:
            points = prepare(points, s)
        return points
    if callable(steps):
        return steps(points)
    name, *args = (steps,) if isinstance(steps, str) else steps
    known = {"l2": unit, "mean_centre": centre, "standardise": lambda p: standardise(p, True, _GUARD), "density": dense_part, "norm": norm_filter}
    if name not in known:
        raise ValueError(f"unknown step {name!r}; known: {', '.join(known)}")
    if args and not math.isfinite(args[0]):
        raise ValueError(f"{name} needs finite settings")
    return known[name](points, *args)
