"""Readings of weights as point clouds: convolution kernels, normalised matrices, sizes in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Axes that name a point of each view, and those that are its coordinates, in order.
CONV = {
    "rows": (("o", "i", "h"), ("w",)),
    "cols": (("o", "i", "w"), ("h",)),
    "kernel": (("o", "i"), ("h", "w")),
    "out_channel": (("o",), ("i", "h", "w")),
    "in_channel": (("i",), ("o", "h", "w")),
    "tap": (("h", "w"), ("o", "i")),
}
_GUARD = 1e-12


def conv_view(kernels: DataFrame, view: str = "kernel") -> DataFrame:
    """(layer_idx, the view's point axes, x): kernels (layer_idx, o, i, h, w, v) as points of at least two coordinates."""
    if view not in CONV:
        raise ValueError(f"unknown view {view!r}")
    at, of = CONV[view]
    points = kernels.groupBy("layer_idx", *at).agg(F.transform(F.array_sort(F.collect_list(F.struct(*of, "v"))), lambda s: s["v"]).alias("x"))
    few = F.raise_error(F.lit(f"view {view} gives points of one coordinate"))
    return points.withColumn("x", F.when(F.size("x") < 2, few.cast("array<double>")).otherwise(F.col("x")))


def conv_view_shape(shape: tuple[int, ...], view: str) -> tuple[int, int]:
    """(points, coordinates) of a view of a tensor (out, in, h, w) or (out, in, w)."""
    size = dict(zip("oihw", shape if len(shape) == 4 else (*shape[:2], 1, shape[2])))
    n = [1, 1]
    for side, axes in enumerate(CONV[view]):
        for a in axes:
            n[side] *= size[a]
    return n[0], n[1]


def view_shape(shape: tuple[int, int], view: str, part: str = "upper") -> tuple[int, int]:
    """(points, coordinates) of a matrix view; part is upper or full and counts for the Gram views."""
    r, c = shape
    n = c if "col" in view else r
    if view == "full":
        return 1, r * c
    if view in ("rows", "cols"):
        return (r, c) if view == "rows" else (c, r)
    if view in ("gram_rows", "gram_cols"):
        return 1, n * (n + 1) // 2 if part == "upper" else n * n
    if view in ("row_norm", "col_norm", "row_sum", "col_sum", "gram_diag"):
        return 1, n
    raise ValueError(f"unknown view {view!r}")


def normalise_rows(weights: DataFrame, how: str | None) -> DataFrame:
    """weights (layer_idx, i, j, w) with rows of unit length (rows), or centred first (correlation)."""
    if how is None:
        return weights
    if how not in ("rows", "correlation"):
        raise ValueError(f"unknown normalisation {how!r}")
    row = weights.groupBy("layer_idx", "i").agg(F.avg("w").alias("_m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_s"), F.sqrt(F.var_pop("w") * F.count(F.lit(1))).alias("_c"))
    x = (F.col("w") - F.col("_m")) / (F.col("_c") + _GUARD) if how == "correlation" else F.col("w") / (F.col("_s") + _GUARD)
    return weights.join(row, ["layer_idx", "i"]).withColumn("w", x).drop("_m", "_s", "_c")


def flat(weights: DataFrame) -> DataFrame:
    """(layer_idx, x): each matrix as one point, row by row."""
    return weights.groupBy("layer_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "w"))), lambda s: s["w"]).alias("x"))
