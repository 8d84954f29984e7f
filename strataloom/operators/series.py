"""Series over training: smoothing, settling, distances between steps, dimension of trajectories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import EULER, distance_block, magnitude_scales, magnitude_slope, point_tree, slope_of_magnitudes, two_nn_dimension
from ..functions.magnitude import magnitudes, median_distance
from ..sources.scratch import written
from .points import BLOCK, Nearest, nearest_within


def smooth(series: DataFrame, window: int = 5) -> DataFrame:
    """series (key, step, v) with s: centred moving average, the edge values repeated beyond the ends."""
    h = window // 2
    w = Window.partitionBy("key").orderBy("step")
    x = series.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("v").over(whole), F.last("v").over(whole)
    inside = F.sum("v").over(w.rowsBetween(-h, h))
    before, after = F.greatest(F.lit(0), h + 1 - F.col("_i")), F.greatest(F.lit(0), F.col("_i") + h - F.col("_n"))
    return x.withColumn("s", (inside + before * first + after * last) / (2 * h + 1)).drop("_i", "_n")


def settle(series: DataFrame, frac: float = 0.1, late_n: int = 15, window: int = 5) -> DataFrame:
    """(key, settled): first step from which the smoothed series stays within frac of its late level, between early 1 and late 0.

    Early is the median of the first eighth of the smoothed series, five values at least, late
    that of its last late_n.  Values that aren't finite are left out.  Null if the levels are
    equal, if there are fewer than six values or half of late_n, or if it never stays.
    """
    x = smooth(series.filter(~F.isnan("v") & (F.abs("v") < float("inf"))), window)
    w = Window.partitionBy("key")
    x = x.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("step")))
    head = F.col("_i") <= F.greatest(F.lit(5), F.floor(F.col("_n") / 8))
    tail = F.col("_i") > F.col("_n") - late_n
    level = x.groupBy("key").agg(F.median(F.when(head, F.col("s"))).alias("early"), F.median(F.when(tail, F.col("s"))).alias("late"), F.count(F.lit(1)).alias("n"))
    ok = level.filter((F.col("early") != F.col("late")) & (F.col("n") >= max(6, late_n // 2)))
    z = x.join(ok, "key").withColumn("z", (F.col("s") - F.col("late")) / (F.col("early") - F.col("late")))
    rest = F.max("z").over(w.orderBy("step").rowsBetween(0, Window.unboundedFollowing))
    first = z.withColumn("rest", rest).filter(F.col("rest") <= frac).groupBy("key").agg(F.min("step").alias("settled"))
    return series.select("key").distinct().join(first, "key", "left")


def step_distances(trajectory: DataFrame, how: str = "euclidean") -> DataFrame:
    """(a, b, d) of steps a < b of trajectory (step, coord, v): euclidean, cosine, or loss_difference (mean |difference|)."""
    l, r = (trajectory.select(F.col("step").alias(k), "coord", F.col("v").alias(f"_{k}")) for k in ("a", "b"))
    p = l.join(r, "coord").filter("a < b").groupBy("a", "b")
    x, y = F.col("_a"), F.col("_b")
    d = {
        "euclidean": F.sqrt(F.sum((x - y) * (x - y))), "loss_difference": F.avg(F.abs(x - y)),
        "cosine": 1 - F.sum(x * y) / (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))),
    }[how]
    return p.agg(d.alias("d"))


def rolling_groups(steps: DataFrame, window: int, stride: int = 1) -> DataFrame:
    """steps (step, ...) in every count-based window they belong to: column win, the number of its first step."""
    i = F.dense_rank().over(Window.orderBy("step")) - 1  # over distinct steps, a few thousand at most
    place = steps.select("step").distinct().withColumn("_i", i)
    last = place.agg(F.max("_i").alias("_m"))
    first = F.ceil(F.greatest(F.lit(0), F.col("_i") - window + 1) / stride) * stride
    wins = F.filter(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_i") / stride) * stride, F.lit(stride).cast("long")), lambda s: (s >= first) & (s + window - 1 <= F.col("_m")))
    spread = place.join(F.broadcast(last)).withColumn("win", F.explode(wins)).select("step", "win")  # one row
    return steps.join(spread, "step")


def _grouped(points: DataFrame, f, columns: dict[str, object], metric: str = "euclidean") -> DataFrame:
    """One row of numbers a bundle from its distance matrix; NaN for a bundle that is too small for them."""

    def run(key, t):
        x = np.stack(t.sort_by("id")["x"].to_numpy(zero_copy_only=False)).astype(float)
        try:
            values = f(distance_block(x, x, metric))
        except (ValueError, IndexError, np.linalg.LinAlgError):
            values = [float("nan")] * len(columns)
        return pa.table({"bundle": pa.array([key[0].as_py()], pa.string()), "n": pa.array([len(x)], pa.int64()), **{c: pa.array([float(v)], pa.float64()) for c, v in zip(columns, values)}})

    return points.select(F.col("bundle").cast("string").alias("bundle"), "id", "x").groupBy("bundle").applyInArrow(run, "bundle string, n long, " + ", ".join(f"{c} double" for c in columns))


def _clouds(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle, id, x), and (bundle, n): how many points each bundle has."""
    own = points.select(F.col("bundle").cast("string").alias("bundle"), F.col("id").cast("long").alias("id"), "x")
    return own, own.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))


def _two(near: DataFrame, j: int, k: int) -> DataFrame:
    """(bundle, i, rj, rk): distances to the j-th and the k-th neighbour."""
    return near.groupBy("bundle", "i").agg(*[F.max(F.when(F.col("rank") == r, F.col("d"))).alias(c) for r, c in ((j, "rj"), (k, "rk"))])


def global_dimension(points: DataFrame) -> DataFrame:
    """(bundle, n, dimension): two-nearest-neighbour dimension of each bundle, of any size."""
    own, size = _clouds(points)
    mu = F.when(F.col("rj") > 0, F.col("rk") / F.col("rj"))
    mean = _two(nearest_within(own, 2), 1, 2).groupBy("bundle").agg(F.avg(F.when(mu > 1, F.log(F.log(mu)))).alias("m"))
    value = F.when(F.col("n") > 1, F.coalesce(F.exp(-EULER - F.col("m")), F.lit(0.0))).otherwise(float("nan"))
    return size.join(mean, "bundle", "left").select("bundle", "n", value.alias("dimension"))


def bootstrap_dimension(points: DataFrame, draws: int = 20, share: float = 0.8, seed: int = 0, near: int = 24) -> DataFrame:
    """(bundle, n, mean, std) of the two-nearest-neighbour dimension over random parts of each bundle.

    A part's neighbours are the first two that it holds of a point's `near` nearest of all; where it
    holds fewer, twice as many are looked up.
    """
    own, size = _clouds(points)
    place = F.row_number().over(Window.partitionBy("bundle").orderBy("id")) - 1
    own = written(own.select("bundle", place.cast("long").alias("id"), "x"), "places")
    k = near

    def run(key, t):
        n = t["n"][0].as_py()
        i, rank = t["i"].to_numpy(), t["rank"].to_numpy() - 1
        j, d = np.zeros((n, k), np.int64), np.full((n, k), np.inf)
        held = np.zeros((n, k), bool)
        j[i, rank], d[i, rank], held[i, rank] = t["j"].to_numpy(), t["d"].to_numpy(), True
        values, short = [], False
        for r in range(draws if n > 2 else 0):
            pick = np.random.default_rng([seed, r]).choice(n, max(3, round(share * n)), replace=False)
            inside = np.zeros(n, bool)
            inside[pick] = True
            c = np.cumsum(inside[j[pick]] & held[pick], axis=1)
            short |= k < n - 1 and bool((c[:, -1] < 2).any())
            r1, r2 = (np.where(c[:, -1] >= q, d[pick][np.arange(len(pick)), (c == q).argmax(axis=1)], np.inf) for q in (1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                mu = np.where(r1 > 0, r2 / r1, 1.0)
            mu = mu[mu > 1]
            values.append(float(np.exp(-EULER - np.log(np.log(mu)).mean())) if len(mu) else 0.0)
        mean, std = (float(np.mean(values)), float(np.std(values))) if values else (float("nan"),) * 2
        return pa.table({"bundle": [key[0].as_py()], "mean": [mean], "std": [std], "short": [bool(short)]})

    while True:
        found = nearest_within(own, k).join(size, "bundle").groupBy("bundle").applyInArrow(run, "bundle string, mean double, std double, short boolean")
        found = written(found, "draws")  # a row a bundle
        if not found.filter("short").count():
            break
        k *= 2
    nan = F.lit(float("nan"))
    return size.join(found, "bundle", "left").select("bundle", "n", F.coalesce("mean", nan).alias("mean"), F.coalesce("std", nan).alias("std"))


def _keyed(seed: int, *columns: str):
    """A reproducible random number of a row."""
    return F.xxhash64(F.lit(seed), *columns)


def local_dimension(points: DataFrame, anchors: int = 20, neighbours: int = 64, repeats: int = 3, seed: int = 0, salts: int = 16) -> DataFrame:
    """(bundle, n, mean, std): two-nearest-neighbour dimension of the neighbourhoods of sampled anchors.

    The anchors of every repeat, drawn by hash, meet the points of their bundle in `salts`
    parts; only the nearest points of an anchor, itself among them, come together, so a bundle
    may be of any size.
    """
    own = points.select(F.col("bundle").cast("string").alias("bundle"), "id", "x")
    size = own.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    each = own.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", _keyed(seed, "r", "id"))
    drawn = each.withColumn("_k", F.row_number().over(Window.partitionBy("bundle", "r").orderBy("_h", "id"))).filter(F.col("_k") <= anchors)
    drawn = written(drawn.select("bundle", "r", F.col("id").alias("anchor"), F.col("x").alias("y")), "anchors")  # at most anchors * repeats a bundle
    spread = drawn.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gap = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    met = own.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["bundle", "_s"]).withColumn("d", gap)
    place = F.row_number().over(Window.partitionBy("bundle", "r", "anchor").orderBy("d", "id"))
    near = met.withColumn("_k", place).filter(F.col("_k") <= neighbours + 1).select("bundle", "r", "anchor", "id", "x")

    def run(key, t):
        x = np.stack(t.sort_by("id")["x"].to_numpy(zero_copy_only=False)).astype(float)
        value = two_nn_dimension(distance_block(x, x)) if len(x) > 2 else float("nan")
        return pa.table({"bundle": pa.array([key[0].as_py()], pa.string()), "value": pa.array([value])})

    per = near.groupBy("bundle", "r", "anchor").applyInArrow(run, "bundle string, value double")
    return size.join(per.groupBy("bundle").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), "bundle").select("bundle", "n", "mean", "std")


def _log_statistic(rj: np.ndarray, rk: np.ndarray) -> float:
    """Mean of -ln ln(R_k / R_j) where it is defined."""
    ok = (rj > 0) & (rk > rj)
    return float(-np.log(np.log(rk[ok] / rj[ok])).mean()) if ok.any() else float("nan")


def calibrated_dimension(points: DataFrame, k: int = 10, j: int = 5, dims: tuple[int, ...] = tuple(range(1, 21)), repeats: int = 5, seed: int = 0) -> DataFrame:
    """(bundle, n, dimension): exp(alpha L + beta), alpha and beta by least squares on Gaussian clouds of known dimension and the same size.

    Every Gaussian cloud is a task of its own that holds its points, not their distances; bundles of one size share them.
    """
    own, size = _clouds(points)
    size = written(size, "sizes")

    def gaussian(key, t):
        n, dim, r = (v.as_py() for v in key)
        x = np.random.default_rng([seed, dim, r]).normal(size=(n, dim))
        ids, rj, rk = np.arange(n), [], []
        for s in range(0, n, BLOCK):
            near = Nearest(ids[s : s + BLOCK], x[s : s + BLOCK], k, "euclidean")
            near.see(ids, x)
            _, _, rank, d = near.rows()
            rj.append(d[rank == j])
            rk.append(d[rank == k])
        value = _log_statistic(np.concatenate(rj), np.concatenate(rk))
        return pa.table({"n": pa.array([n], pa.int64()), "dim": pa.array([dim], pa.int32()), "r": pa.array([r], pa.int32()), "v": [value]})

    def fit(key, t):
        t = t.sort_by([("dim", "ascending"), ("r", "ascending")])
        v, dim = t["v"].to_numpy(), t["dim"].to_numpy()
        ok = np.isfinite(v)
        alpha, beta = np.polyfit(v[ok], np.log(dim[ok]), 1) if ok.any() else (float("nan"),) * 2
        return pa.table({"n": pa.array([key[0].as_py()], pa.int64()), "alpha": [float(alpha)], "beta": [float(beta)]})

    every = size.select("n").distinct().filter(F.col("n") > k)
    every = every.withColumn("dim", F.explode(F.array(*[F.lit(int(q)) for q in dims]))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    line = every.repartition(4 * len(dims) * repeats, "n", "dim", "r").groupBy("n", "dim", "r").applyInArrow(gaussian, "n long, dim int, r int, v double").groupBy("n").applyInArrow(fit, "n long, alpha double, beta double")
    ok = (F.col("rj") > 0) & (F.col("rk") > F.col("rj"))
    stat = _two(nearest_within(own, k), j, k).groupBy("bundle").agg((-F.avg(F.when(ok, F.log(F.log(F.col("rk") / F.col("rj")))))).alias("s"))
    value = F.coalesce(F.exp(F.col("alpha") * F.col("s") + F.col("beta")), F.lit(float("nan")))
    return size.join(stat, "bundle", "left").join(line, "n", "left").select("bundle", "n", value.alias("dimension"))


# The subset sizes of the published estimator, and those for smaller clouds.
SIZES, FEWER_SIZES = tuple(range(200, 1001, 50)), (50, 100, 200, 500)


def ph_dimension(points: DataFrame, alpha: float = 1.0, sizes: tuple[int, ...] | None = None, seed: int = 0, metric: str = "euclidean") -> DataFrame:
    """(bundle, n, dimension, slope): alpha / (1 - b), b the log-log slope of the summed tree lengths of random subsets.

    A subset holds the points of the least hashes; every subset is a task of its own, so a
    bundle may be of any size.  NaN for bundles that are too small for two sizes.
    """
    own = points.select(F.col("bundle").cast("string").alias("bundle"), "id", "x")
    n = F.col("n")
    fit = lambda x: F.filter(F.array(*[F.lit(int(s)) for s in x]), lambda s: s <= n)
    some = fit(sizes or SIZES)
    if sizes is None:
        low = F.greatest(F.lit(10), F.floor(n / 8)).cast("double")
        spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(low * F.pow(n / low, i / 4) + 1e-9).cast("int")))
        some = F.when(F.size(some) > 1, some).when(F.size(fit(FEWER_SIZES)) > 1, fit(FEWER_SIZES)).otherwise(F.filter(spaced, lambda s: s <= n))
    size = own.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).withColumn("sizes", some)
    each = own.select("bundle", "id").join(size.select("bundle", F.explode("sizes").alias("s")), "bundle").withColumn("_h", _keyed(seed, "s", "id"))
    drawn = each.withColumn("_k", F.row_number().over(Window.partitionBy("bundle", "s").orderBy("_h", "id"))).filter(F.col("_k") <= F.col("s")).select("bundle", "s", "id")
    held = drawn.join(own, ["bundle", "id"])

    def run(key, t):
        x = np.stack(t.sort_by("id")["x"].to_numpy(zero_copy_only=False)).astype(float)
        total = sum(w**alpha for w, _, _ in point_tree(x, metric))
        return pa.table({"bundle": pa.array([key[0].as_py()], pa.string()), "s": pa.array([key[1].as_py()], pa.int32()), "total": pa.array([float(total)])})

    per = held.groupBy("bundle", "s").applyInArrow(run, "bundle string, s int, total double")
    line = per.filter("total > 0").groupBy("bundle").agg(F.regr_slope(F.log("total"), F.log("s")).alias("slope"))
    nan = F.lit(float("nan"))
    b = F.when(F.size("sizes") > 1, F.col("slope"))
    out = size.join(line, "bundle", "left")
    return out.select("bundle", "n", F.when(b < 1, alpha / (1 - b)).otherwise(nan).alias("dimension"), F.coalesce(b, nan).alias("slope"))


#: Points whose matrix is solved at once, and tasks that share the scales of a larger bundle.
DIRECT, SHARES = 2048, 6


def magnitude_dimension(points: DataFrame, scales: int = 30, direct: int = DIRECT) -> DataFrame:
    """(bundle, n, dimension): largest slope of log magnitude over log scale.

    A bundle of more points than direct goes to several tasks, each with some of the scales; a task holds the points and a few numbers a point and scale, no matrix.
    """

    def some(key, t):
        x, share = np.stack(t.sort_by("id")["x"].to_numpy(zero_copy_only=False)).astype(float), key[1].as_py()
        at, m, slope = [], [], None
        if share is None:
            try:
                slope = magnitude_slope(distance_block(x, x), scales)
            except (ValueError, IndexError, np.linalg.LinAlgError):
                slope = float("nan")
        elif np.isfinite(x).all() and np.isfinite(median := median_distance(x)):
            at = magnitude_scales(median, scales)[share::SHARES]
            m = magnitudes(x, at)
        return pa.table({"bundle": pa.array([key[0].as_py()], pa.string()), "n": pa.array([len(x)], pa.int64()), "t": pa.array([list(at)], pa.list_(pa.float64())), "m": pa.array([list(m)], pa.list_(pa.float64())), "slope": pa.array([slope], pa.float64())})

    def whole(key, rows):
        slope, n = rows["slope"][0].as_py(), rows["n"][0].as_py()
        if slope is None:
            at, m = (np.concatenate([np.array(v, float) for v in rows[c].to_pylist()]) for c in ("t", "m"))
            order = np.argsort(at)
            slope = slope_of_magnitudes(n, at[order], m[order])
        return pa.table({"bundle": pa.array([key[0].as_py()], pa.string()), "n": pa.array([n], pa.int64()), "dimension": pa.array([slope], pa.float64())})

    own = points.select(F.col("bundle").cast("string").alias("bundle"), "id", "x")
    large = F.count(F.lit(1)).over(Window.partitionBy("bundle")) > direct
    shares = F.when(large, F.array(*[F.lit(k) for k in range(SHARES)])).otherwise(F.array(F.lit(None).cast("int")))
    each = own.withColumn("share", shares).withColumn("share", F.explode("share")).groupBy("bundle", "share").applyInArrow(some, "bundle string, n long, t array<double>, m array<double>, slope double")
    return each.groupBy("bundle").applyInArrow(whole, "bundle string, n long, dimension double")


def roc(scores: DataFrame) -> DataFrame:
    """(score, tpr, fpr) of scores (score, y) from high to low, one point a distinct score.

    Running sums go by parts of the score's range, each with what stands above it, so no task sorts all scores.
    """
    per = scores.groupBy("score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    part = per.repartitionByRange(F.desc("score")).withColumn("_part", F.spark_partition_id())
    sums = {r["_part"]: (r["p"], r["n"]) for r in part.groupBy("_part").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}  # a row a partition
    above, rows = (0, 0), []
    for k in sorted(sums):
        rows.append((k, *above))
        above = (above[0] + sums[k][0], above[1] + sums[k][1])
    base = scores.sparkSession.createDataFrame(rows or [(0, 0, 0)], "_part int, _p long, _n long")
    w = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.sum("p").over(w) + F.col("_p"), F.sum("n").over(w) + F.col("_n")
    x = part.join(F.broadcast(base), "_part").select("score", tp.alias("tp"), n.alias("n"))
    return x.select("score", F.try_divide(F.col("tp").cast("double"), F.lit(float(above[0]))).alias("tpr"), F.try_divide((F.col("n") - F.col("tp")).cast("double"), F.lit(float(above[1] - above[0]))).alias("fpr"))
