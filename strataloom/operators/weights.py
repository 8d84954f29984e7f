"""Layered weight graphs as tables (layer_idx, i, j, w): neuron i of layer layer_idx to neuron j of the next."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.kernels import laplacian_vectors, reduce_complex
from .forest import TASK_EDGES, spanning_forest
from .points import BLOCK, against, meeting


def edge_weights(weights: DataFrame, how: str, activations: DataFrame | None = None) -> DataFrame:
    """Edge values: absolute, normalized (by the layer's largest), global_normalized, relevance, weighted_activation.

    relevance: positive part over its sum in column j, 0 where that is 0.  weighted_activation:
    |w| times the absolute mean activation (layer_idx, i, a) of neuron i.
    """
    w = F.col("w")
    if how == "relevance":
        pos = F.greatest(w, F.lit(0.0))
        s = F.sum(pos).over(Window.partitionBy("layer_idx", "j"))
        return weights.withColumn("r", F.when(s > 0, pos / s).otherwise(0.0))
    if how == "weighted_activation":
        mean = activations.groupBy("layer_idx", "i").agg(F.avg("a").alias("_a"))
        return weights.join(mean, ["layer_idx", "i"]).withColumn("r", F.abs(w * F.col("_a"))).drop("_a")
    if how == "absolute":
        return weights.withColumn("r", F.abs(w))
    if how == "normalized":
        top = weights.groupBy("layer_idx").agg(F.max(F.abs("w")).alias("_m"))  # a row a layer
        return weights.join(top, "layer_idx").withColumn("r", F.when(F.col("_m") > 0, F.abs(w) / F.col("_m")).otherwise(0.0)).drop("_m")
    if how == "global_normalized":
        top = weights.agg(F.max(F.abs("w")).alias("_m"))
        return weights.join(F.broadcast(top)).withColumn("r", F.when(F.col("_m") > 0, F.abs(w) / F.col("_m")).otherwise(0.0)).drop("_m")  # one row
    raise ValueError(f"unknown edge weight {how!r}")


def induced_paths(edges: DataFrame, layers: int) -> DataFrame:
    """(from_layer, to_layer, i, k, r): largest product of r over the layer-ordered paths; one join on the middle neuron a layer."""
    e = edges.select("layer_idx", "i", "j", "r")
    out, last = [], None
    for span in range(1, layers + 1):
        if last is None:
            last = e.select(F.col("layer_idx").alias("from_layer"), (F.col("layer_idx") + 1).alias("to_layer"), "i", F.col("j").alias("k"), "r")
        else:
            a = last.select("from_layer", F.col("to_layer").alias("layer_idx"), F.col("i").alias("src"), F.col("k").alias("i"), F.col("r").alias("_r"))
            last = a.join(e, ["layer_idx", "i"]).groupBy("from_layer", (F.col("layer_idx") + 1).alias("to_layer"), F.col("src").alias("i"), F.col("j").alias("k")).agg(F.max(F.col("_r") * F.col("r")).alias("r"))
        out.append(last)
    return reduce(DataFrame.unionByName, out)


# The thresholds of the published analysis.
def clique_schedule() -> list[float]:
    """64 falling thresholds: nine steps in each of seven decades, then the smallest."""
    return [c / 10 * 10.0**-e for e in range(7) for c in range(10, 1, -1)] + [1e-7]


def schedule_index(r: Column, thresholds: list[float]) -> Column:
    """How many thresholds exceed r, plus one."""
    return sum((F.lit(t) > r).cast("int") for t in thresholds) + F.lit(1)


def triangles(edges: DataFrame) -> DataFrame:
    """(layer_idx, i, j, k, r): two-step paths with the product of their relevances, the triangles of the directed clique complex."""
    e = edges.select("layer_idx", "i", "j", "r")
    nxt = e.select((F.col("layer_idx") - 1).alias("layer_idx"), F.col("i").alias("j"), F.col("j").alias("k"), F.col("r").alias("_r"))
    return e.join(nxt, ["layer_idx", "j"]).select("layer_idx", "i", "j", "k", (F.col("r") * F.col("_r")).alias("r"))


def clique_relevance(weights: DataFrame, mode: str = "positive", by: str | None = None) -> DataFrame:
    """weights with r, the relevance that the clique complex uses: the positive part (or, absolute, the magnitude) over its sum in column j (of each model) and 1e-12."""
    part = {"positive": F.greatest("w", F.lit(0.0)), "absolute": F.abs("w")}[mode]
    return weights.withColumn("r", part / (F.sum(part).over(Window.partitionBy(*([by] if by else []), "layer_idx", "j")) + 1e-12))


def clique_diagram(edges: DataFrame, least: float = 1e-7, by: str | None = None) -> DataFrame:
    """(dim, birth, death, birth_edge, death_triangle): persistence of the directed clique complex over schedule indices, one model in one group.

    by: a column that tells several models apart (a member, an epoch); it leads the result, and every model is a group.

    The last two hold the real weights (layer:i:j) under the simplices that make and end a
    loop: an edge's own, or the two on the strongest path under an edge between layers two apart.
    """

    def run(t):
        thr = clique_schedule()
        fil = lambda r: sum(x > r for x in thr) + 1
        cells: dict[tuple, float] = {}
        by: dict[tuple, list] = {}
        for layer, i, j, r in zip(*(t[c].to_pylist() for c in ("layer_idx", "i", "j", "r"))):
            a, b = (layer, i), (layer + 1, j)
            cells.setdefault((a,), 0)
            cells.setdefault((b,), 0)
            if r >= least:
                cells[(a, b)] = fil(r)
                by.setdefault(a, []).append((b, r))
        best: dict[tuple, tuple] = {}
        for a, nexts in list(by.items()):
            for b, r in nexts:
                for c, s in by.get(b, ()):
                    best[(a, c)] = max(best.get((a, c), (0, ())), (r * s, (-b[1], b)))
                    cells[(a, b, c)] = fil(r * s)
        for e, (r, _) in best.items():
            cells[e] = min(cells.get(e, math.inf), fil(r))

        def real(s: tuple) -> list[str]:
            """The weights under a simplex."""
            if len(s) == 2 and s[1][0] == s[0][0] + 2:
                s = (s[0], best[s][1][1], s[1])
            return [f"{a[0]}:{a[1]}:{b[1]}" for a, b in zip(s, s[1:])]

        for s in [s for s in cells if len(s) == 3]:
            cells[s] = max(cells[s], *(cells[s[:x] + s[x + 1 :]] for x in range(3)))
        found = reduce_complex([(s, float(f)) for s, f in cells.items()])
        rows = [(k, b, d, real(s) if k else [], real(e) if k and e else None) for k, b, d, s, e in found if k <= 1 and (d > b or k == 0)]
        return pa.table({
            "dim": pa.array([r[0] for r in rows], pa.int32()), "birth": pa.array([r[1] for r in rows], pa.float64()), "death": pa.array([r[2] for r in rows], pa.float64()),
            "birth_edge": pa.array([r[3] for r in rows], pa.list_(pa.string())), "death_triangle": pa.array([r[4] for r in rows], pa.list_(pa.string())),
        })

    bars = "dim int, birth double, death double, birth_edge array<string>, death_triangle array<string>"
    if by is None:
        return edges.select("layer_idx", "i", "j", "r").groupBy(F.lit("all")).applyInArrow(run, bars)
    kind = edges.schema[by].dataType

    def own(key, t):
        out = run(t)
        return out.add_column(0, by, pa.array([key[0].as_py()] * len(out), t.schema.field(by).type))

    return edges.select(by, "layer_idx", "i", "j", "r").groupBy(by).applyInArrow(own, f"`{by}` {kind.simpleString()}, {bars}")


def superlevel_h0(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(bundle, birth, death): merges of a weighted graph (bundle, u, v, w) from heavy to light edges, as distance max - w; absent edges never join.

    The merges are the edges of the maximum spanning forest; each component keeps one bar without end.
    """
    tree, parts = spanning_forest(edges, largest=True, task_edges=task_edges)
    top = edges.groupBy("bundle").agg(F.max("w").alias("top"))
    ends = tree.join(top, "bundle").select("bundle", (F.col("top") - F.col("w")).alias("death"))
    open_ = parts.select("bundle", "name").distinct().select("bundle", F.lit(float("inf")).alias("death"))
    return ends.unionByName(open_).select("bundle", F.lit(0.0).alias("birth"), "death")


def node_features(edges: DataFrame, k) -> DataFrame:
    """(bundle, node, features): k Laplacian eigenvectors of each weighted graph (bundle, u, v, w), or what a function of its matrix gives, a row a node."""

    def run(key, t):
        u, v, w = (t[c].to_pylist() for c in ("u", "v", "w"))
        names = sorted({*u, *v})
        at = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, x in zip(u, v, w):
            m[at[a], at[b]] = m[at[b], at[a]] = x
        f = np.asarray(k(m), float).reshape(len(names), -1) if callable(k) else laplacian_vectors(m, k)
        return pa.table({"bundle": pa.array([key[0].as_py()] * len(names)), "node": pa.array(names), "features": pa.array(f.tolist(), pa.list_(pa.float64()))})

    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("bundle", "u")}
    return edges.groupBy("bundle").applyInArrow(run, f"bundle {kinds['bundle']}, node {kinds['u']}, features array<double>")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select("bundle", F.col("u").alias("node"), "w").unionByName(edges.select("bundle", F.col("v").alias("node"), "w"))
    return both.groupBy("bundle", "node").agg(F.sum("w").alias("strength"), F.count(F.lit(1)).alias("degree"))


class _Sparse:
    """Rows of a matrix, as the places of their entries."""

    def __init__(self, t: pa.Table, names: np.ndarray | None = None):
        self.ids, o = t["id"].to_numpy(), t["o"].combine_chunks()
        n = np.concatenate([c.value_lengths().to_numpy() for c in t["o"].chunks]) if t["o"].num_chunks else np.zeros(0, int)
        row, flat = np.repeat(np.arange(len(n)), n), np.concatenate([np.zeros(0, int), *[c.flatten().to_numpy(zero_copy_only=False) for c in t["o"].chunks]]) if len(o) else np.zeros(0, int)
        w = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in t["w"].chunks]])
        self.names = np.unique(flat) if names is None else names
        place = np.minimum(np.searchsorted(self.names, flat), max(0, len(self.names) - 1))
        known = self.names[place] == flat if len(self.names) else np.zeros(len(flat), bool)
        self.row, self.place, self.w = row[known], place[known], w[known]
        self.whole = len(self.row) == len(n) * len(self.names) and (np.bincount(self.row * len(self.names) + self.place, minlength=1) == 1).all() if len(self.row) < 1 << 26 else False

    def part(self, x: int, y: int, c: int, d: int, entries: bool) -> np.ndarray:
        """Rows x to y and columns c to d, filled; or 1 where there is an entry."""
        lo, hi = np.searchsorted(self.row, (x, y))
        row, place, w = self.row[lo:hi] - x, self.place[lo:hi], self.w[lo:hi]
        if c or d < len(self.names):
            use = (place >= c) & (place < d)
            row, place, w = row[use], place[use], w[use]
        out = np.bincount(row * (d - c) + place - c, None if entries else w, (y - x) * (d - c)).reshape(y - x, d - c)
        return out.astype(np.float32) if entries else out


def _gram(weights: DataFrame, axis: str, other: str, lags: bool, block: int = BLOCK) -> DataFrame:
    """(layer_idx, a, b, v): products of the rows a <= b of each matrix that share a column; lags: (layer_idx, lag, s, c), their sums and counts by b - a, from each block.

    Blocks of rows meet one another as products of matrices, so no product of two entries is a row.
    """
    kind = {c: weights.schema[c].dataType.simpleString() for c in ("layer_idx", axis)}
    entry = F.collect_list(F.struct(F.col(other).alias("o"), F.col("w").cast("double").alias("w"))).alias("e")
    rows = weights.groupBy("layer_idx", F.col(axis).alias("id")).agg(entry).select("layer_idx", "id", F.col("e.o").alias("o"), F.col("e.w").alias("w"))
    wide, tall, deep = 2048, 512, 4096  # others, own rows and columns at a time
    id_type, layer_type = pa.from_numpy_dtype("int64") if kind[axis] == "bigint" else None, rows.schema["layer_idx"].dataType

    class Task:
        def __init__(self, key, t):
            self.layer, self.own, self.lags = key[0], _Sparse(t), []

        def meet(self, t, own):
            y = _Sparse(t, self.own.names)
            x, k = self.own, len(self.own.names)
            for s in range(0, len(x.ids), tall):
                for q in range(0, len(y.ids), wide):
                    s1, q1 = min(s + tall, len(x.ids)), min(q + wide, len(y.ids))
                    v, shared = np.zeros((s1 - s, q1 - q)), np.zeros((s1 - s, q1 - q), np.float32)
                    for c in range(0, k, deep):
                        d = min(c + deep, k)
                        v += x.part(s, s1, c, d, False) @ y.part(q, q1, c, d, False).T
                        if not (x.whole and y.whole):
                            shared += x.part(s, s1, c, d, True) @ y.part(q, q1, c, d, True).T
                    ok = shared > 0 if not (x.whole and y.whole) else np.full(v.shape, k > 0)
                    a, b = x.ids[s:s1, None], y.ids[None, q:q1]
                    if own:
                        ok &= a <= b
                    u, w = np.nonzero(ok)
                    if not len(u):
                        continue
                    a, b, v = x.ids[s:s1][u], y.ids[q:q1][w], v[u, w]
                    a, b = (a, b) if own else (np.where(a < b, a, b), np.where(a < b, b, a))
                    if lags:
                        self._add(b - a, v)
                    else:
                        yield pa.record_batch({"layer_idx": pa.array([self.layer] * len(a)) if not isinstance(self.layer, int) else pa.array(np.full(len(a), self.layer, np.int64)), "a": pa.array(a, id_type), "b": pa.array(b, id_type), "v": pa.array(v)})

        def _add(self, lag, v, c=None):
            name, at = np.unique(lag, return_inverse=True)
            self.lags.append((name, np.bincount(at, v), np.bincount(at, c)))
            if c is None and sum(len(x) for x, _, _ in self.lags) > 1 << 22:
                self._compact()

        def _compact(self):
            lag, v, c = (np.concatenate(x) for x in zip(*self.lags))
            self.lags = []
            self._add(lag, v, c)

        def end(self):
            if self.lags:
                self._compact()
                lag, v, c = self.lags[0]
                yield pa.record_batch({"layer_idx": pa.array([self.layer] * len(lag)), "lag": pa.array(lag), "s": pa.array(v), "c": pa.array(c.astype(float))})

    met = against(rows.withColumn("layer_idx", F.col("layer_idx").cast("long") if kind["layer_idx"] in ("int", "smallint", "tinyint") else F.col("layer_idx")), ("layer_idx",), block, True)
    layer = met.schema["layer_idx"].dataType.simpleString()
    run = meeting(("layer_idx",), Task)
    if lags:
        step = "double" if kind[axis] in ("float", "double") else "long"
        out = met.mapInArrow(run, f"layer_idx {layer}, lag {step}, s double, c double")
    else:
        out = met.mapInArrow(run, f"layer_idx {layer}, a {kind[axis]}, b {kind[axis]}, v double")
    return out.withColumn("layer_idx", F.col("layer_idx").cast(layer_type))


def matrix_view(weights: DataFrame, view: str) -> DataFrame:
    """row_norm, col_norm, row_sum, col_sum: (layer_idx, n, v); gram_rows, gram_cols: (layer_idx, a, b, v) with a <= b; gram_diag: (layer_idx, lag, v); rows, cols: (layer_idx, n, x)."""
    axis, other = ("i", "j") if "row" in view or view == "gram_diag" else ("j", "i")
    if view.endswith("_norm"):
        return weights.groupBy("layer_idx", F.col(axis).alias("n")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("v"))
    if view.endswith("_sum"):
        return weights.groupBy("layer_idx", F.col(axis).alias("n")).agg(F.sum("w").alias("v"))
    if view in ("rows", "cols"):
        return weights.groupBy("layer_idx", F.col(axis).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(other, "w"))), lambda s: s["w"]).alias("x"))
    if view == "gram_diag":
        sums = _gram(weights, axis, other, True).groupBy("layer_idx", "lag").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        return sums.select("layer_idx", "lag", (F.col("s") / F.col("c")).alias("v"))
    if view in ("gram_rows", "gram_cols"):
        return _gram(weights, axis, other, False)
    raise ValueError(f"unknown view {view!r}")


def weight_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("layer_idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("fro"), F.sum(F.abs("w")).alias("l1"), F.max(F.abs("w")).alias("max_abs"), F.count_if(F.col("w") == 0).alias("zeros"))


def neuron_correlation(activations: DataFrame) -> DataFrame:
    """(layer_idx, i, j, w): magnitude of the correlation over samples of neuron i of a layer with neuron j of the next, from activations (sample, layer_idx, i, a); 0 for a constant one."""
    w = Window.partitionBy("layer_idx", "i")
    z = activations.withColumn("z", F.try_divide(F.col("a") - F.avg("a").over(w), F.stddev_pop("a").over(w)))
    z = z.withColumn("z", F.coalesce("z", F.lit(0.0)))
    nxt = z.select((F.col("layer_idx") - 1).alias("layer_idx"), "sample", F.col("i").alias("j"), F.col("z").alias("_z"))
    return z.join(nxt, ["layer_idx", "sample"]).groupBy("layer_idx", "i", "j").agg(F.abs(F.avg(F.col("z") * F.col("_z"))).alias("w"))


def magnitude_mask(weights: DataFrame, ratio: float) -> DataFrame:
    """weights with kept: |w| above the k-th smallest, k = round(ratio * n); ties at the threshold go."""
    n = weights.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.bround(F.col("n") * ratio).cast("long"))
    per = weights.groupBy(F.abs("w").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    # The threshold from counts of distinct values: a running total over ranges, not over all rows.
    cut = _kth(per, n)
    return weights.join(F.broadcast(cut)).withColumn("kept", F.col("cut").isNull() | (F.abs("w") > F.col("cut"))).drop("cut")  # one row


def _kth(per: DataFrame, n: DataFrame) -> DataFrame:
    """One row with the value at place k of the sorted multiset per (m, c); null for k = 0."""
    k = n.select("k").first()[0]
    if not k:
        return n.select(F.lit(None).cast("double").alias("cut"))
    lo, hi = None, None
    part = per
    while True:  # narrow the range by quantiles until one value is left
        size = part.agg(F.count(F.lit(1))).first()[0]
        if size <= 10_000:
            run = 0
            for m, c in sorted(map(tuple, part.collect())):
                run += c
                if run >= k:
                    return n.select(F.lit(float(m)).alias("cut"))
        mid = part.agg(F.percentile_approx("m", F.lit(0.5), F.lit(1000))).first()[0]
        below = part.filter(F.col("m") <= mid).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        if k <= below:
            part = part.filter(F.col("m") <= mid)
        else:
            k, part = k - below, part.filter(F.col("m") > mid)


def loop_mask(weights: DataFrame, diagram: DataFrame, ratio: float) -> DataFrame:
    """weights with kept, from the loops of clique_diagram(): the weights under loops by rising birth plus death until the budget is met, then the largest |w|.

    The budget is the rounded share 1 - ratio of all weights; the last loop may overshoot it.
    Each loop counts the weights that no earlier one holds; running sums over the loops give
    those taken, and the fill is cut by the k-th largest magnitude, ties by place.
    """
    bars = diagram.filter((F.col("dim") == 1) & (F.col("death") < float("inf"))).withColumn("edge", F.explode(F.array_distinct(F.concat("birth_edge", F.coalesce("death_triangle", F.array().cast("array<string>"))))))
    loop = F.struct((F.col("birth") + F.col("death")).alias("s"), "birth", F.array_join("birth_edge", ",").alias("e"), F.array_join(F.coalesce("death_triangle", F.array().cast("array<string>")), ",").alias("t"))
    first = bars.groupBy("edge").agg(F.min(loop).alias("loop"))
    budget = weights.agg(F.bround((1 - ratio) * F.count(F.lit(1))).cast("long").alias("n")).first()["n"]
    new = first.groupBy("loop").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("loop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the loops of one diagram
    taken = first.join(new.withColumn("b", before).filter(F.col("b") < budget).select("loop"), "loop", "left_semi").select("edge")
    x = weights.withColumn("edge", F.concat_ws(":", "layer_idx", "i", "j")).join(taken.withColumn("_in", F.lit(True)), "edge", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    held = x.agg(F.count_if("_in")).first()[0]
    k = max(0, budget - held)
    if not k:
        return x.withColumn("kept", F.col("_in")).drop("_in", "edge")
    rest = x.filter(~F.col("_in"))
    per = rest.groupBy(F.abs("w").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    cut = _kth(per.withColumn("m", -F.col("m")), weights.sparkSession.range(1).select(F.lit(k).alias("k"))).first()["cut"]
    above = rest.agg(F.count_if(F.abs("w") > -cut)).first()[0]
    tie = rest.filter(F.abs("w") == -cut).orderBy("layer_idx", "i", "j").limit(k - above).select("edge", F.lit(True).alias("_tie"))
    x = x.join(tie, "edge", "left")
    return x.withColumn("kept", F.col("_in") | (F.abs("w") > -cut) | F.coalesce("_tie", F.lit(False))).drop("_in", "_tie", "edge")


def prune_report(masked: DataFrame) -> DataFrame:
    """(layer_idx, n, kept, dead): weights, weights kept, columns without any."""
    col = masked.groupBy("layer_idx", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"))
    return col.groupBy("layer_idx").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.count_if(F.col("kept") == 0).alias("dead"))
