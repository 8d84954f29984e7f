"""Layers, snapshots and populations of models as tables: catalogues, selections, factored weights, aligned series."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window, functions as F

#: Kinds of layer that each named selection takes; None takes every layer with parameters.
SELECTIONS = {
    "all_linear": ("linear",), "all_conv": ("conv",), "soro": ("soro",), "all_attention": ("attention",), "all_embedding": ("embedding",), "linear_and_conv": ("linear", "conv"), "all": None,
}


def catalogue(weights: DataFrame) -> DataFrame:
    """(layer_idx, n_in, n_out, params, nonzero) of a table of weights."""
    return weights.groupBy("layer_idx").agg(
        F.count_distinct("i").alias("n_in"), F.count_distinct("j").alias("n_out"), F.count(F.lit(1)).alias("params"), F.count_if(F.col("w") != 0).alias("nonzero")
    )


def select_layers(layers: DataFrame, selection: str | list | None = None) -> DataFrame:
    """Rows of layers (layer_idx, name, kind, params) that a selection takes.

    selection: a name of SELECTIONS, a list of names or of places among the layers with
    parameters (negative ones count from the end), or None: the linear and factored layers
    if there are any, else the convolutions, else every layer with parameters.
    """
    own = layers.filter("params > 0")
    if selection is None:
        kinds = {r["kind"] for r in own.select("kind").distinct().collect()}  # a few kinds
        full = kinds & {"linear", "soro"}
        if full and "conv" in kinds:
            warnings.warn("the model has linear and convolution layers: the linear ones are taken", UserWarning, stacklevel=2)
        return own.filter(F.col("kind").isin(list(full) or ["conv"])) if full or "conv" in kinds else own
    if isinstance(selection, str):
        if selection not in SELECTIONS:
            raise ValueError(f"unknown selection {selection!r}; known: {', '.join(SELECTIONS)}")
        kinds = SELECTIONS[selection]
        return own if kinds is None else own.filter(F.col("kind").isin(list(kinds)))
    if all(isinstance(x, str) for x in selection):
        known = {r["name"] for r in own.filter(F.col("name").isin(selection)).select("name").collect()}  # as many as asked for
        if missing := [x for x in selection if x not in known]:
            raise KeyError(f"no such layers: {', '.join(missing)}")
        return own.filter(F.col("name").isin(selection))
    rank = own.withColumn("_p", F.row_number().over(Window.orderBy("layer_idx")) - 1)  # a catalogue is as long as a model is deep
    n = own.count()
    places = [x + n if x < 0 else x for x in selection]
    if bad := [x for x, p in zip(selection, places) if not 0 <= p < n]:
        raise IndexError(f"no layers at {bad}")
    return rank.filter(F.col("_p").isin(places)).drop("_p")


def layer_of(table: DataFrame, layer: int | str, column: str = "layer_idx") -> DataFrame:
    """The rows of one layer; a layer that isn't there is an error, not an empty result."""
    rows = table.filter(F.col(column) == layer)
    if not rows.limit(1).count():
        raise KeyError(f"no layer {layer!r}")
    return rows


def effective_weights(u: DataFrame, sigma: DataFrame, v: DataFrame) -> DataFrame:
    """(layer_idx, i, j, w) of factored layers: u (layer_idx, j, r, u), sigma (layer_idx, r, s), v (layer_idx, i, r, v); w = sum over r of v s u."""
    terms = v.join(sigma, ["layer_idx", "r"]).join(u, ["layer_idx", "r"])
    return terms.groupBy("layer_idx", "i", "j").agg(F.sum(F.col("v") * F.col("s") * F.col("u")).alias("w"))


def coupled(weights: DataFrame, activations: DataFrame) -> DataFrame:
    """(sample, layer_idx, i, a): the inputs of each layer, from activations (sample, layer_idx, i, a) of layers, the model's input as layer -1.

    A layer takes what the one before it gives.  If that is a whole multiple of the layer's
    width, as of a sequence, its last slice is taken; other widths are an error.
    """
    wide = weights.groupBy("layer_idx").agg((F.max("i") + 1).alias("n"))
    have = activations.groupBy((F.col("layer_idx") + 1).alias("layer_idx")).agg((F.max("i") + 1).alias("m"))
    size = wide.join(have, "layer_idx")  # a row a layer
    a = activations.withColumn("layer_idx", F.col("layer_idx") + 1).join(size, "layer_idx")
    bad = F.raise_error(F.format_string("layer %s takes %s values but is given %s", F.col("layer_idx"), F.col("n"), F.col("m")))
    i = F.when(F.col("m") % F.col("n") != 0, bad.cast("long")).otherwise(F.col("i") - (F.col("m") - F.col("n")))
    return a.withColumn("i", i).filter("i >= 0").select("sample", "layer_idx", "i", "a")


def concat_activations(activations: DataFrame, layers: list[int] | None = None) -> DataFrame:
    """(id, x): each sample's activations (sample, layer_idx, i, a) of some layers, or of all, one layer after the other."""
    own = activations if layers is None else activations.filter(F.col("layer_idx").isin(layers))
    return own.groupBy(F.col("sample").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("layer_idx", "i", "a"))), lambda s: s["a"]).alias("x"))


def snapshot_at(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, step): the step of steps (step) nearest to each wanted one (want), the earlier one on ties.

    Steps up to a wanted one and beyond it are found by two running extremes over the sorted union, not by a join.
    """
    both = steps.select(F.col("step").cast("double").alias("at"), F.col("step")).distinct().unionByName(wanted.select(F.col("want").cast("double").alias("at"), F.lit(None).cast(steps.schema["step"].dataType).alias("step")).distinct())
    order = Window.orderBy("at")  # over steps of training, not over data
    x = both.withColumn("lo", F.last("step", True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first("step", True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("hi").isNull() | (F.col("at") - F.col("lo") <= F.col("hi") - F.col("at")), F.col("lo")).otherwise(F.col("hi"))
    return x.filter("step is null").select(F.col("at").alias("want"), F.coalesce(near, F.col("hi")).alias("step"))


def aligned(series: DataFrame, steps: DataFrame) -> DataFrame:
    """(key, step, v) with a row for every step and key; v is null where the series has none."""
    return series.select("key").distinct().join(F.broadcast(steps.select("step").distinct())).join(series, ["key", "step"], "left")  # the steps of one training


def checkpoints(steps: DataFrame, n: int) -> DataFrame:
    """(place, step): n steps at evenly spaced places, rounded down; all if there are no more."""
    place = steps.select("step").distinct().withColumn("place", F.row_number().over(Window.orderBy("step")) - 1)
    m = place.agg(F.count(F.lit(1)).alias("m"))
    pick = F.array(*[F.floor(F.lit(float(k)) * (F.col("m") - 1) / max(1, n - 1)) for k in range(n)])
    return place.join(F.broadcast(m)).filter((F.col("m") <= n) | F.array_contains(pick, F.col("place").cast("long"))).select("place", "step")  # one row


def population_cloud(weights: DataFrame, view: str = "full", normalise: str | None = None) -> DataFrame:
    """(layer_idx, member_id, n, x): the points of a view of every member's layers, from weights (member_id, layer_idx, i, j, w).

    full: a member is one point of all weights; rows, cols: a point for each neuron; row_norm,
    col_norm: one point of the norms.  normalise: l2 scales each point to length 1,
    mean_centre subtracts the mean point of the layer.
    """
    if view in ("full", "rows", "cols"):
        axis, other = {"full": (F.lit(0).cast("long"), ("i", "j")), "rows": (F.col("i"), ("j",)), "cols": (F.col("j"), ("i",))}[view]
        cells = weights.select("layer_idx", "member_id", axis.alias("n"), F.struct(*other).alias("at"), "w")
    elif view in ("row_norm", "col_norm"):
        of = view[0] == "r" and "i" or "j"
        norm = weights.groupBy("layer_idx", "member_id", of).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w"))
        cells = norm.select("layer_idx", "member_id", F.lit(0).cast("long").alias("n"), F.struct(of).alias("at"), "w")
    else:
        raise ValueError(f"unknown view {view!r}")
    if normalise == "mean_centre":
        cells = cells.withColumn("w", F.col("w") - F.avg("w").over(Window.partitionBy("layer_idx", "at")))
    x = F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda s: s["w"])
    out = cells.groupBy("layer_idx", "member_id", "n").agg(x.alias("x"))
    if normalise == "l2":
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)) + 1e-12
        out = out.withColumn("_l", length).withColumn("x", F.transform("x", lambda v: v / F.col("_l"))).drop("_l")
    elif normalise not in (None, "mean_centre"):
        raise ValueError(f"unknown normalisation {normalise!r}")
    return out


def member_index(cloud: DataFrame) -> DataFrame:
    """(layer_idx, id, member_id, n): the member and neuron behind each point, numbered by member and neuron within its layer."""
    order = Window.partitionBy("layer_idx").orderBy("member_id", "n")
    return cloud.select("layer_idx", (F.row_number().over(order) - 1).cast("long").alias("id"), "member_id", "n")
