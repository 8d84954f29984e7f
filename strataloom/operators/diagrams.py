"""Persistence diagrams as tables (bundle, dim, birth, death): statistics, curves, distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import streamed
from ..functions.cohomology import Sparse, pairs, sparse_edges, sparse_lengths
from ..functions.kernels import bottleneck, distance_block, hull_area, point_tree, rips, wasserstein
from .forest import spanning_forest

KEYS = ("bundle", "dim")
_INF = float("inf")


def finite(diagram: DataFrame) -> DataFrame:
    """Finite bars with their length."""
    ok = (~F.isnan("birth")) & (~F.isnan("death")) & (F.abs("birth") < _INF) & (F.abs("death") < _INF)
    return diagram.filter(ok).withColumn("life", F.col("death") - F.col("birth"))


def clean(diagram: DataFrame) -> DataFrame:
    """A death that is not a number becomes infinite, a birth that isn't finite 0."""
    return diagram.withColumn("death", F.when(F.isnan("death"), F.lit(_INF)).otherwise(F.col("death"))).withColumn(
        "birth", F.when(F.isnan("birth") | (F.abs("birth") == _INF), F.lit(0.0)).otherwise(F.col("birth"))
    )


def statistics(diagram: DataFrame, p: float = 1.0, q: float = 2.0) -> DataFrame:
    """Per bundle and dimension: total_persistence, persistence_norm, persistence_entropy, and the suite over bars of positive length."""
    bars = finite(diagram)
    w = Window.partitionBy(*KEYS)
    live = bars.filter("life > 0").withColumn("total", F.sum("life").over(w)).withColumn("i", F.row_number().over(w.orderBy("life", "birth")))
    share = F.col("life") / F.col("total")
    n, s = F.count(F.lit(1)), F.sum("life")
    out = live.groupBy(*KEYS).agg(
        n.alias("n"), F.sum(F.pow("life", F.lit(p))).alias("total_persistence"), F.pow(F.sum(F.pow("life", F.lit(q))), F.lit(1 / q)).alias("persistence_norm"),
        (-F.sum(share * F.log(share))).alias("entropy"), F.avg("life").alias("mean"), F.median("life").alias("median"), F.max("life").alias("max"), F.min("life").alias("min"),
        F.stddev_pop("life").alias("std"), F.when(n <= 1, 0.0).otherwise(2 * F.sum(F.col("i") * F.col("life")) / (n * s) - (n + 1) / n).alias("gini"), (F.max("life") / s).alias("top1"),
        F.coalesce(F.nanvl(F.skewness("life"), F.lit(0.0)), F.lit(0.0)).alias("skew"), F.avg("birth").alias("birth_mean"), F.max("birth").alias("birth_max"),
    )
    return out


def moments(diagram: DataFrame) -> DataFrame:
    """Mean and population deviation of birth, death and their squares, over finite bars."""
    cols = {"b": F.col("birth"), "d": F.col("death"), "b2": F.pow("birth", F.lit(2)), "d2": F.pow("death", F.lit(2))}
    return finite(diagram).groupBy(*KEYS).agg(*[f(c).alias(f"{n}_{k}") for k, c in cols.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def betti_at(diagram: DataFrame, eps: float) -> DataFrame:
    """Bars with birth <= eps <= death, both ends closed."""
    return diagram.groupBy(*KEYS).agg(F.count_if((F.col("birth") <= eps) & (F.col("death") >= eps)).alias("betti"))


def _grid(bars: DataFrame, points: int) -> DataFrame:
    """A grid from the least birth to the greatest finite death of each bundle and dimension."""
    hi = F.max(F.when(F.col("death") < _INF, F.col("death")))
    r = bars.groupBy(*KEYS).agg(F.min("birth").alias("lo"), hi.alias("hi"))
    r = r.withColumn("hi", F.when(F.col("hi").isNull() | (F.col("hi") <= F.col("lo")), F.col("lo") + 1).otherwise(F.col("hi")))
    return r.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("t", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (points - 1))


def betti_curve(diagram: DataFrame, points: int = 100) -> DataFrame:
    """(bundle, dim, step, t, betti).  Counts starts and ends up to each grid point with running sums instead of joining bars to the grid."""
    grid = _grid(diagram, points)
    marks = diagram.select(*KEYS, F.col("birth").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("up"))
    ends = diagram.filter(F.col("death") < _INF).select(*KEYS, F.col("death").alias("t"), F.lit(2).alias("o"), F.lit(-1).alias("up"))
    at = grid.select(*KEYS, "t", F.lit(1).alias("o"), F.lit(0).alias("up"), "step")
    every = marks.unionByName(ends).withColumn("step", F.lit(None).cast("int")).unionByName(at)
    run = F.sum("up").over(Window.partitionBy(*KEYS).orderBy("t", "o", "step").rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("betti", run).filter("step is not null").select(*KEYS, "step", "t", "betti")


def landscape(diagram: DataFrame, levels: int = 3, points: int = 20) -> DataFrame:
    """(bundle, dim, step, level, value): the level-th largest tent at each grid point; 0 where fewer bars stand.

    A bar meets only the grid points it spans, so what is ranked is the bars over a point, not bars times grid.
    """
    bars = finite(diagram)
    grid = _grid(bars, points)
    r = grid.filter("step = 0").select(*KEYS, "lo", "hi")
    x = bars.join(r, list(KEYS)).withColumn("gap", (F.col("hi") - F.col("lo")) / (points - 1))
    first, last = (F.ceil((F.col("birth") - F.col("lo")) / F.col("gap") - 1e-9), F.floor((F.col("death") - F.col("lo")) / F.col("gap") + 1e-9))
    x = x.withColumn("a", F.greatest(F.lit(0), first).cast("int")).withColumn("b", F.least(F.lit(points - 1), last).cast("int")).filter("a <= b")
    x = x.withColumn("step", F.explode(F.sequence("a", "b"))).withColumn("t", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (points - 1))
    tent = x.withColumn("value", F.greatest(F.lit(0.0), F.least(F.col("t") - F.col("birth"), F.col("death") - F.col("t"))))
    k = F.row_number().over(Window.partitionBy(*KEYS, "step").orderBy(F.desc("value"), "birth", "death"))
    top = tent.withColumn("level", k).filter(F.col("level") <= levels).select(*KEYS, "step", "level", "value")
    every = grid.select(*KEYS, "step").withColumn("level", F.explode(F.array(*[F.lit(i + 1) for i in range(levels)])))
    return every.join(top, [*KEYS, "step", "level"], "left").na.fill(0.0, ["value"])


def image(diagram: DataFrame, pixels: int = 5, sigma: float = 0.1, weight: str = "linear") -> DataFrame:
    """(bundle, dim, px, py, value): a Gaussian of each bar at (birth, length) on a grid over their ranges.

    weight: linear (the bar's length), squared, or none.
    """
    power = {"linear": 1, "squared": 2, "none": 0}[weight]
    bars = finite(diagram)
    r = bars.groupBy(*KEYS).agg(F.min("birth").alias("b0"), F.max("birth").alias("b1"), F.max("life").alias("l1"))
    step = F.sequence(F.lit(0), F.lit(pixels - 1))
    grid = r.withColumn("px", F.explode(step)).withColumn("py", F.explode(step))
    gx = F.col("b0") + (F.col("b1") - F.col("b0")) * F.col("px") / (pixels - 1)
    gy = F.col("l1") * F.col("py") / (pixels - 1)
    e = F.exp(-(F.pow(F.col("birth") - gx, F.lit(2)) + F.pow(F.col("life") - gy, F.lit(2))) / (2 * sigma**2))
    return bars.join(grid, list(KEYS)).groupBy(*KEYS, "px", "py").agg(F.sum(F.pow("life", F.lit(power)) * e).alias("value"))


def nearest_step(v: Column, schedule: list[float]) -> Column:
    """The value of the schedule nearest to v, the lower one on ties."""
    s = sorted(schedule)
    out = F.lit(s[-1])
    for a, b in reversed(list(zip(s, s[1:]))):
        out = F.when(v - a <= b - v, F.lit(a)).otherwise(out)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == _INF), v).otherwise(out)


def snap(diagram: DataFrame, schedule: list[float]) -> DataFrame:
    return diagram.withColumns({c: nearest_step(F.col(c), schedule) for c in ("birth", "death")})


def multiplicity(diagram: DataFrame) -> DataFrame:
    """(bundle, dim, birth, death, n, log_n) of identical points."""
    return diagram.groupBy(*KEYS, "birth", "death").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10(1 + F.col("n")))


def longest(diagram: DataFrame, bars: int = 40) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(F.desc("life"), "birth")
    return finite(diagram).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= bars)


def mean_diagram(diagram: DataFrame, group: str) -> DataFrame:
    """(group, pos, birth, death): elementwise mean of diagrams whose bars stand in order of length."""
    w = Window.partitionBy(group, "bundle").orderBy(F.desc(F.col("death") - F.col("birth")), "birth")
    return finite(diagram).withColumn("pos", F.row_number().over(w)).groupBy(group, "pos").agg(F.avg("birth").alias("birth"), F.avg("death").alias("death"))


def distances(a: DataFrame, b: DataFrame, order: float = 1.0) -> DataFrame:
    """(bundle, dim, wasserstein, bottleneck) of the finite parts of two tables of diagrams."""

    def pair(key, x, y):
        p, q = (np.column_stack([t["birth"].to_numpy(), t["death"].to_numpy()]) for t in (x, y))
        return pa.table({"bundle": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "wasserstein": [wasserstein(p, q, order)], "bottleneck": [bottleneck(p, q)]})

    f = [finite(x).select(F.col("bundle").cast("string").alias("bundle"), F.col("dim").cast("int").alias("dim"), "birth", "death").groupBy(*KEYS) for x in (a, b)]
    return f[0].cogroup(f[1]).applyInArrow(pair, "bundle string, dim int, wasserstein double, bottleneck double")


def hull_areas(diagram: DataFrame) -> DataFrame:
    def area(key, t):
        p = np.column_stack([t["birth"].to_numpy(), t["death"].to_numpy()])
        return pa.table({"bundle": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "area": [hull_area(p)]})

    return diagram.select(F.col("bundle").cast("string").alias("bundle"), F.col("dim").cast("int").alias("dim"), "birth", "death").groupBy(*KEYS).applyInArrow(area, "bundle string, dim int, area double")


_BARS = "bundle string, dim int, birth double, death double"

#: Tasks that bundles are dealt to at most, and the points of a cloud whose distances are kept together.
TASKS, KEPT = 256, 2048


def _dealt(points: DataFrame) -> DataFrame:
    """Clouds dealt to tasks by ranges of their names: a large bundle gets a task of its own, where hashes, or Spark when it joins small partitions, would put several in one."""
    return points.select(F.col("bundle").cast("string").alias("bundle"), "id", "x").repartitionByRange(TASKS, "bundle")


def _bars(bundle: str | None, bars: list[tuple[int, float, float]]) -> pa.Table:
    return pa.table({
        "bundle": pa.array([bundle] * len(bars), pa.string()), "dim": pa.array([k for k, _, _ in bars], pa.int32()),
        "birth": pa.array([b for _, b, _ in bars], pa.float64()), "death": pa.array([e for _, _, e in bars], pa.float64()),
    })


def _cloud(t: pa.Table) -> np.ndarray:
    return np.stack(t.sort_by("id")["x"].to_numpy(zero_copy_only=False)).astype(float)


def rips_diagrams(points: DataFrame, max_dim: int = 0, threshold: float = _INF, metric: str = "euclidean", coeff: int = 2) -> DataFrame:
    """Diagrams of clouds (bundle, id, x), one group a bundle; a bundle must fit a task, and above dimension 1 or over another field than Z/2 its distance matrix too.

    Loops over Z/2 of more than KEPT points take batches of edges in order of length from rows of distances.
    """
    kept = KEPT

    def run(key, t):
        x = _cloud(t)
        if max_dim == 0:
            tree = point_tree(x, metric, threshold)
            bars = [(0, 0.0, w) for w, _, _ in tree] + [(0, 0.0, _INF)] * (len(x) - len(tree))
        elif max_dim == 1 and coeff == 2 and len(x) > kept:
            bars = streamed.pairs(streamed.Rows(lambda i: distance_block(x[i], x, metric), len(x), threshold))
        else:
            d = distance_block(x, x, metric)
            np.fill_diagonal(d, 0)
            bars = rips(d, max_dim, threshold, coeff)
        return _bars(key[0].as_py(), bars)

    own = _dealt(points) if max_dim else points.select(F.col("bundle").cast("string").alias("bundle"), "id", "x")
    return own.groupBy("bundle").applyInArrow(run, _BARS)


def sparse_diagrams(points: DataFrame, eps: float, metric: str = "euclidean", coeff: int = 2) -> DataFrame:
    """Diagrams of dimensions 0 and 1 of clouds (bundle, id, x), from a sparse filtration: births and deaths differ from those of rips_diagrams by a factor of 1 + eps at most.

    Edges are chosen by a greedy order of the points, so their number grows with the points and
    not their pairs; rows of distances are made one at a time, or once if the points are few.  metric must be a metric.
    """
    if not eps > 0:
        raise ValueError("eps must be positive")
    kept = KEPT

    def run(key, t):
        x = _cloud(t)
        row = distance_block(x, x, metric).__getitem__ if len(x) <= kept else lambda i: distance_block(x[i : i + 1], x, metric)[0]
        if coeff == 2 and len(x) > kept:
            return _bars(key[0].as_py(), streamed.pairs(streamed.Rows(sparse_lengths(row, len(x), eps), len(x))))
        u, v, length = sparse_edges(row, len(x), eps)
        return _bars(key[0].as_py(), pairs(Sparse(u, v, length, len(x)), True, coeff))

    return _dealt(points).groupBy("bundle").applyInArrow(run, _BARS)


def graph_diagrams_of(edges: DataFrame, max_dim: int = 1, coeff: int = 2) -> DataFrame:
    """Diagrams of graphs (bundle, u, v, d) as clique filtrations by the lengths d; pairs without an edge never meet.

    Dimension 0 comes from the spanning forests, whose graphs may be of any size.  Loops need a
    graph's edges in one task, and no matrix.  Of parallel edges the shortest counts; loops at
    a node and edges of null length only make their ends nodes.
    """
    own = edges.select(F.col("bundle").cast("string").alias("bundle"), "u", "v", F.col("d").cast("double").alias("w"))
    tree, parts = spanning_forest(own)
    bars = tree.select("bundle", F.col("w").alias("death")).unionByName(parts.select("bundle", "name").distinct().select("bundle", F.lit(_INF).alias("death")))
    bars = bars.select("bundle", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), "death")
    if max_dim == 0:
        return bars

    def run(key, t):
        names = {x: i for i, x in enumerate(sorted({*t["u"].to_pylist(), *t["v"].to_pylist()}))}
        u, v = (np.array([names[x] for x in t[c].to_pylist()], np.int64) for c in ("u", "v"))
        return _bars(key[0].as_py(), [b for b in pairs(Sparse(u, v, t["w"].to_numpy(), len(names)), True, coeff) if b[0]])

    real = own.filter("u is not null and v is not null and w is not null and not isnan(w)")
    return bars.unionByName(real.groupBy("bundle").applyInArrow(run, _BARS))


def prune(diagram: DataFrame, least: float) -> DataFrame:
    """Bars of at least a length; bars that never die stay."""
    return diagram.filter((F.col("death") == _INF) | (F.col("death") - F.col("birth") >= least))


def infinity_line(diagram: DataFrame, margin: float = 0.1) -> DataFrame:
    """(bundle, lo, hi, line): the range of the finite births and deaths of a bundle, and where bars without an end may be drawn, a margin above it."""
    v = diagram.select("bundle", F.explode(F.array("birth", "death")).alias("v")).filter(~F.isnan("v") & (F.abs("v") < _INF))
    r = v.groupBy("bundle").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return r.withColumn("line", F.col("hi") + margin * F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0))


def schedule(spec: int | list | tuple | dict, diagram: DataFrame | None = None) -> list[float]:
    """Thresholds of a filtration.

    An int: so many, evenly spaced over all births and deaths of a diagram.  A list: itself,
    in its order.  A dict: linear or log (min, max, n), rising; or log_decades (max, n_decades,
    per_decade), falling: each decade's head, per_decade even steps to the next head, and in
    the end the last decade's foot.
    """
    if isinstance(spec, bool) or not isinstance(spec, (int, list, tuple, dict)):
        raise TypeError(f"a schedule is an int, a list or a dict, not {type(spec).__name__}")
    if isinstance(spec, int):
        if diagram is None:
            raise ValueError("a number of thresholds needs a diagram")
        v = diagram.select(F.explode(F.array("birth", "death")).alias("v"))
        lo, hi = v.agg(F.min("v"), F.max("v")).first()
        if lo is None:
            return [0.0]
        return np.linspace(lo, hi if hi > lo else lo + 1, spec).tolist()
    if isinstance(spec, (list, tuple)):
        return [float(x) for x in spec]
    kind = spec.get("type", "linear")
    if kind in ("linear", "log"):
        return (np.linspace if kind == "linear" else np.geomspace)(spec["min"], spec["max"], spec["n"]).tolist()
    if kind != "log_decades":
        raise ValueError(f"unknown schedule {kind!r}")
    top, decades, steps = float(spec.get("max", 1.0)), int(spec.get("n_decades", 7)), int(spec.get("per_decade", 8))
    heads = top * 10.0 ** -np.arange(decades)
    inside = heads[:, None] - np.arange(steps + 1) * (heads * 0.9 / (steps + 1))[:, None]
    return list(dict.fromkeys([*inside.reshape(-1).tolist(), top * 10.0**-decades]))


def snap_index(diagram: DataFrame, thresholds: list[float]) -> DataFrame:
    """The diagram with births and deaths as places in the thresholds, in their own order; infinite deaths stay infinite."""
    place = {t: float(i) for i, t in reversed(list(enumerate(thresholds)))}
    out = snap(diagram, thresholds)
    for c in ("birth", "death"):
        to = F.col(c)
        index = F.lit(None).cast("double")
        for t, i in place.items():
            index = F.when(to == t, F.lit(i)).otherwise(index)
        out = out.withColumn(c, F.coalesce(index, to))
    return out


def check_distances(distances: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(bundle, n, bad_numbers, negative, diagonal, asymmetric, missing) of distances (bundle, i, j, d): counts of entries against the rules of a distance matrix.

    Infinite entries stand for pairs without a distance.  All entries of the square must be there.
    """
    d = F.col("d")
    bad = d.isNull() | F.isnan(d) | (d == -_INF)
    here = distances.select("bundle", F.explode(F.array("i", "j")).alias("i"))
    both = distances.select("bundle", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") <= F.col("j")).alias("up"), "d").filter("a <> b")
    pair = both.groupBy("bundle", "a", "b").agg(F.max(F.when(F.col("up"), F.col("d"))).alias("x"), F.max(F.when(~F.col("up"), F.col("d"))).alias("y"))
    off = ~F.isnan("x") & ~F.isnan("y") & ~(F.col("x") == F.col("y")) & ~(F.abs(F.col("x") - F.col("y")) <= tolerance)
    wrong = pair.groupBy("bundle").agg(F.count_if(off).alias("asymmetric"))
    nodes = here.groupBy("bundle").agg(F.count_distinct("i").alias("n"))
    one = distances.groupBy("bundle").agg(
        F.count_if(bad).alias("bad_numbers"), F.count_if(~bad & (d < 0)).alias("negative"), F.count_if(~bad & (F.col("i") == F.col("j")) & (F.abs(d) > tolerance)).alias("diagonal"), F.count(F.lit(1)).alias("_c")
    )
    out = nodes.join(one, "bundle").join(wrong, "bundle", "left").na.fill(0, ["asymmetric"])
    return out.select("bundle", "n", "bad_numbers", "negative", "diagonal", "asymmetric", (F.col("n") * F.col("n") - F.col("_c")).alias("missing"))


def matrix_diagrams(entries: DataFrame, kind: str = "distance", max_dim: int = 1, threshold: float = _INF, coeff: int = 2) -> DataFrame:
    """(bundle, dim, birth, death) of a user's own matrices, as entries (bundle, i, j, d).

    distance: both halves or one; a diagonal entry may be left out, another missing one is an
    error.  knn: distances to some neighbours; the mean of the two directions, an absent one
    counting as 0, and pairs without either are twice the largest and 1 more apart.
    similarity: heavier is nearer; the distance is the largest weight less the weight, 0 for absent pairs.
    Entries that break the rules of a distance matrix are an error.
    """
    if kind not in ("distance", "knn", "similarity"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(key, t):
        i, j, d = (t[c].to_numpy() for c in ("i", "j", "d"))
        names = np.unique(np.r_[i, j])
        n = len(names)
        m = np.full((n, n), np.nan)
        a, b = np.searchsorted(names, i), np.searchsorted(names, j)
        m[a, b] = d
        if kind == "distance":
            m = np.where(np.isnan(m), m.T, m)
            np.fill_diagonal(m, np.where(np.isnan(np.diag(m)), 0, np.diag(m)))
            if np.isnan(m).any() or (m < 0).any() or np.abs(np.diag(m)).max() > 1e-6 or not np.allclose(m, m.T, atol=1e-6):
                raise ValueError(f"bundle {key[0].as_py()} holds no distance matrix: see check_distances")
        elif kind == "knn":
            g = np.nan_to_num(m)
            m = np.where((g > 0) | (g.T > 0), (g + g.T) / 2, 2 * g.max() + 1)
        else:
            w = np.nan_to_num(m)
            w = np.maximum(w, w.T)
            m = w.max() - w
        np.fill_diagonal(m, 0)
        return _bars(key[0].as_py(), rips((m + m.T) / 2, max_dim, threshold, coeff))

    own = entries.select(F.col("bundle").cast("string").alias("bundle"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
    return own.groupBy("bundle").applyInArrow(run, _BARS)
