"""Point clouds: distances, nearest neighbours and what is built on them.

A cloud is a table (id, x array<double>).  The points are dealt to large blocks; a task
holds a block and the others pass by it in batches, so none holds the cloud, and a point
travels once a block.  Euclidean and angular distances are screened by matrix products,
with the bound of their error, and those that may count are worked out as differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from collections.abc import Callable, Iterator

from ..functions.kernels import EULER, distance_block
from ..functions.screen import OTHERS as _OTHERS, PAIRS as _PAIRS, ROWS as _ROWS, Nearest, Screen, exact as _exact
from ..sources.scratch import written

#: Points of a block at most, and how many blocks a small cloud is cut into, of LEAST points each or more.
BLOCK, SOME, LEAST = 1 << 14, 24, 1024


def against(points: DataFrame, keys: tuple[str, ...] = (), block: int = BLOCK, half: bool = False, asks=None, gives=None) -> DataFrame:
    """points (keys, id, x, ...) with a, the block they meet, and side: 0 for the block's own, 1 for those that pass by it, sorted for meeting().

    Blocks are of the same keys.  half: of two blocks only one meets the other.  asks, gives:
    conditions of the points that make blocks, and of those that pass by them; all by default.
    """
    asks, gives = (F.lit(True) if c is None else c for c in (asks, gives))
    p = points.withColumn("_asks", asks).withColumn("_gives", gives)
    n = F.count(F.lit(1))
    least = min(block, LEAST)
    blocks = F.greatest(F.ceil(n / block), F.least(F.lit(SOME), F.ceil(n / least))).cast("int").alias("_n")
    size = p.filter("_asks").groupBy(*keys).agg(n.alias("_c"), blocks)
    total = int(size.agg(F.sum("_n")).first()[0] or 0)
    own = p.join(size.drop("_c"), list(keys)) if keys else p.withColumn("_n", F.lit(max(1, total)).cast("int"))
    own = own.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    mine = F.col("_own") == F.col("a")
    meets = F.col("_gives")
    if half:  # of (a, b) and (b, a) one, by turns
        meets = meets & ((F.col("_own") > F.col("a")) == ((F.col("_own") + F.col("a")) % 2 == 0))
    own = own.filter((mine & (F.col("_asks") | F.col("_gives"))) | (~mine & meets))
    own = own.withColumn("side", F.when(mine & F.col("_asks"), 0).otherwise(1)).drop("_asks", "_gives", "_own", "_n")
    parts = max(1, min(3 * total, 2048))
    return own.repartition(parts, *keys, "a").sortWithinPartitions(*keys, "a", "side")


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros((0, 1))
    flat, n = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or flat.null_count or (n != n[0]).any():
        raise ValueError("points must have coordinates, equally many")
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def meeting(keys: tuple[str, ...], make: Callable, itself: bool = True):
    """A function of the batches of against(): make(key, rows of a block) gives an object, to whose meet() the others come, and the block's own first if itself.

    meet(rows, own) and end() yield record batches.
    """
    names = [*keys, "a"]

    def run(batches: Iterator[pa.RecordBatch]):
        key, own, now = None, [], None

        def begun():
            rows = pa.concat_tables(own)
            it = make(key[:-1], rows)
            return it, (it.meet(rows, True) if itself else ())

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            change = np.zeros(t.num_rows, bool)
            for c in names:
                v = t[c].to_numpy() if c == "a" else np.array(t[c].to_pylist(), object)
                change[1:] |= v[1:] != v[:-1]
            edge = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            for x, y in zip(edge, edge[1:]):
                part = t.slice(x, y - x)
                k = tuple(part[c][0].as_py() for c in names)
                if k != key:
                    if own and now is None:
                        now, first = begun()
                        yield from first
                    if now is not None:
                        yield from now.end()
                    key, own, now = k, [], None
                m = int((part["side"].to_numpy() == 0).sum())
                if m:
                    own.append(part.slice(0, m))
                if m < part.num_rows and own:
                    if now is None:
                        now, first = begun()
                        yield from first
                    yield from now.meet(part.slice(m), False)
        if own and now is None:
            now, first = begun()
            yield from first
        if now is not None:
            yield from now.end()

    return run


def nearest_within(points: DataFrame, k: int, keys: tuple[str, ...] = ("bundle",), metric: str = "euclidean", block: int = BLOCK, asks=None, gives=None, last: bool = False) -> DataFrame:
    """(keys, i, j, rank, d): the k nearest other points of each point among those of the same keys, ties by id; from those that ask, among those that give.  last: only the k-th."""
    block = min(block, max(LEAST, (1 << 21) // k))  # a task holds k rows for each point of its block
    kinds = [points.schema[c] for c in keys]
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kinds) + "i long, j long, rank int, d double"

    class Task:
        def __init__(self, key, rows):
            self.key, self.near = key, Nearest(rows["id"].to_numpy(), rows_of(rows["x"]), k, metric)

        def meet(self, rows, own):
            self.near.see(rows["id"].to_numpy(), rows_of(rows["x"]))
            return ()

        def end(self):
            i, j, rank, d = self.near.rows()
            if last:
                i, j, rank, d = (v[rank == k] for v in (i, j, rank, d))
            for s in range(0, len(i), 1 << 17):
                e = slice(s, s + (1 << 17))
                named = {c: pa.array([v] * len(i[e])) for c, v in zip(keys, self.key)}
                yield pa.record_batch({**named, "i": pa.array(i[e], pa.int64()), "j": pa.array(j[e], pa.int64()), "rank": pa.array(rank[e]), "d": pa.array(d[e])})

    rows = against(points.select(*keys, "id", "x", *(["label"] if asks is not None or gives is not None else [])), keys, block, False, asks, gives)
    return rows.select(*keys, "a", "side", "id", "x").mapInArrow(meeting(keys, Task, asks is None and gives is None), schema)


def nearest(points: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(i, j, rank, d): the k nearest other points of each point, ties by id."""
    return nearest_within(points, k, (), metric, block)


def distance_sums(points: DataFrame, exponent: float = 1.0, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(i, p, m), one row or more a point: sums of its distances to the exponent, and the largest of them; the point's own distance is in."""

    class Task:
        def __init__(self, key, rows):
            self.ids, self.x = rows["id"].to_numpy(), rows_of(rows["x"])
            self.p, self.m = np.zeros(len(self.ids)), np.zeros(len(self.ids))

        def meet(self, rows, own):
            ids, x = rows["id"].to_numpy(), rows_of(rows["x"])
            p, m = np.zeros(len(ids)), np.zeros(len(ids))
            for s in range(0, len(self.ids), _ROWS):
                d = distance_block(self.x[s : s + _ROWS], x, metric)
                q = d**exponent if np.isfinite(exponent) else d
                self.p[s : s + _ROWS] += q.sum(axis=1)
                self.m[s : s + _ROWS] = np.maximum(self.m[s : s + _ROWS], d.max(axis=1, initial=0))
                p += q.sum(axis=0)
                m = np.maximum(m, d.max(axis=0, initial=0))
            if not own:
                yield pa.record_batch({"i": pa.array(ids, pa.int64()), "p": pa.array(p), "m": pa.array(m)})

        def end(self):
            yield pa.record_batch({"i": pa.array(self.ids, pa.int64()), "p": pa.array(self.p), "m": pa.array(self.m)})

    return against(points.select("id", "x"), (), block, True).mapInArrow(meeting((), Task), "i long, p double, m double")


def pairs_within(points: DataFrame, eps: float, metric: str = "euclidean", block: int = BLOCK, scale: str | None = None) -> DataFrame:
    """(i, j, d) of the pairs i < j at distance eps or less; scale: a column, the distance is over the root of its product for the two."""

    class Task:
        def __init__(self, key, rows):
            self.ids, self.x = rows["id"].to_numpy(), rows_of(rows["x"])
            self.r = rows[scale].to_numpy() if scale else None
            self.screen = Screen(self.x, metric) if metric == "euclidean" and not scale and np.isfinite(eps) else None
            self.bound = np.full(len(self.ids), float(eps))

        def meet(self, rows, own):
            ids, x = rows["id"].to_numpy(), rows_of(rows["x"])
            r = rows[scale].to_numpy() if scale else None
            for t in range(0, len(ids), _OTHERS):
                other, y = ids[t : t + _OTHERS], x[t : t + _OTHERS]
                for s in range(0, len(self.ids), 256):
                    mine = self.ids[s : s + 256]
                    if self.screen:
                        p, q = self.screen(s, s + len(mine), y, self.bound)
                        d = np.concatenate([np.zeros(0), *[_exact(self.x[s + p[c : c + _PAIRS]], y[q[c : c + _PAIRS]], metric) for c in range(0, len(p), _PAIRS)]])
                        ok = d <= eps
                        p, q, d = p[ok], q[ok], d[ok]
                    else:
                        d = distance_block(self.x[s : s + 256], y, metric)
                        if scale:
                            d /= np.sqrt(self.r[s : s + 256, None] * r[None, t : t + _OTHERS])
                        p, q = np.nonzero(d <= eps)
                        d = d[p, q]
                    u, v = mine[p], other[q]
                    ok = u < v if own else u != v
                    if ok.any():
                        yield pa.record_batch({"i": pa.array(np.minimum(u, v)[ok], pa.int64()), "j": pa.array(np.maximum(u, v)[ok], pa.int64()), "d": pa.array(d[ok], pa.float64())})

        def end(self):
            return ()

    return against(points.select("id", "x", *([scale] if scale else [])), (), block, True).mapInArrow(meeting((), Task), "i long, j long, d double")


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least finite entries of each row, ties by the columns' ids."""
    if d.shape[1] > 4 * k:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((d <= edge) & np.isfinite(d))
    else:
        row, col = np.nonzero(np.isfinite(d))
    order = np.lexsort((ids[col], d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def standardise(points: DataFrame, centre: bool = False, guard: float = 0.0) -> DataFrame:
    """Coordinates divided by their population deviation (0 counts as 1), centred if asked; guard is added to it."""
    long = points.select("id", F.posexplode("x").alias("c", "v"))
    stats = long.groupBy("c").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = F.col("s") + guard if guard else F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    v = (F.col("v") - F.col("m") if centre else F.col("v")) / scale
    return long.join(stats, "c").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", v.alias("v")))), lambda s: s["v"]).alias("x"))


def two_nn(points: DataFrame) -> DataFrame:
    """(n, id): the global two-nearest-neighbour dimension."""
    near = nearest(points, 2)
    r = near.groupBy("i").agg(F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("r2"))
    ok = (F.col("r1") > 0) & (F.col("r2") > F.col("r1"))
    mean = F.avg(F.when(ok, F.log(F.log(F.col("r2") / F.col("r1")))))
    return r.agg(F.count_if(ok).alias("n"), F.coalesce(F.exp(-EULER - mean), F.lit(0.0)).alias("id"))


def density_filter(points: DataFrame, k: int, quantile: float) -> DataFrame:
    """(id, density) of the points whose density, one over the mean distance of k neighbours, reaches the quantile."""
    dens = nearest(points, k).groupBy(F.col("i").alias("id")).agg(F.avg("d").alias("m")).select("id", F.when(F.col("m") == 0, F.lit(float("inf"))).otherwise(1 / F.col("m")).alias("density"))
    dens = written(dens, "density")  # used twice
    cut = dens.agg(F.percentile("density", F.lit(quantile)).alias("cut"))
    return dens.join(F.broadcast(cut), F.col("density") >= F.col("cut")).select("id", "density")  # one row


def labelled_vertices(points: DataFrame, source: int, quantile: float = 0.5, metric: str = "euclidean", block: int = BLOCK, gamma: float | None = None) -> DataFrame:
    """(id, gap): points (id, x, label) of the source class whose least distance to other classes is at most gamma, by default that quantile of it."""
    mine = F.coalesce(F.col("label") == source, F.lit(False))
    gaps = nearest_within(points, 1, (), metric, block, mine, ~mine).select(F.col("i").alias("id"), F.col("d").alias("gap"))
    if gamma is not None:
        return gaps.filter(F.col("gap") <= gamma)
    gaps = written(gaps, "gaps")
    cut = gaps.agg(F.percentile("gap", F.lit(quantile)).alias("cut"))
    return gaps.join(F.broadcast(cut), F.col("gap") <= F.col("cut")).select("id", "gap")  # one row


def local_radii(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(id, r): distance to the k-th nearest other point, or to the furthest of fewer; 1 where that is 0."""
    far = nearest(points, k, metric).groupBy(F.col("i").alias("id")).agg(F.max("d").alias("r"))
    return far.select("id", F.when(F.col("r") > 0, F.col("r")).otherwise(1.0).alias("r"))


def labelled_complex(points: DataFrame, source: int | None = None, quantile: float = 0.5, gamma: float | None = None, scale: str = "global", k_local: int = 5, metric: str = "euclidean", most: float = float("inf"), block: int = BLOCK) -> DataFrame:
    """(i, j, d) of the pairs i < j of labelled_vertices() of points (id, x, label): their distance, up to `most`.

    scale local: over the root of the product of the two points' local_radii() among the
    vertices.  source: the least label by default.  Fewer than two labels are an error, as are
    fewer than three vertices.  Extra columns are ignored.
    """
    if scale not in ("global", "local"):
        raise ValueError(f"unknown scale {scale!r}")
    least = points.agg(F.min("label"), F.max("label")).first()
    if least[0] == least[1]:
        raise ValueError("a labelled complex needs two labels or more")
    source = least[0] if source is None else source
    keep = written(labelled_vertices(points, source, quantile, metric, block, gamma).select("id"), "vertices")
    n = keep.count()
    if n < 3:
        raise ValueError(f"{n} points of label {source} are near the others: raise gamma or the quantile")
    own = points.select("id", "x").join(keep, "id", "left_semi")
    if scale == "global":
        return pairs_within(own, most, metric, block)
    r = written(local_radii(own, min(k_local, n - 1), metric), "radii")
    return pairs_within(own.join(r, "id"), most, metric, block, "r")


def patterns(points: DataFrame) -> DataFrame:
    """(pattern, first_id, n): activation patterns (coordinate > 0) and the points of each region."""
    p = F.array_join(F.transform("x", lambda v: (v > 0).cast("int").cast("string")), "")
    return points.select("id", p.alias("pattern")).groupBy("pattern").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def pool_activations(acts: DataFrame, how: str) -> DataFrame:
    """acts (sample, pos, unit, v) pooled over pos: last, first, mean or max; (sample, unit, v)."""
    agg = {"last": F.max_by("v", "pos"), "first": F.min_by("v", "pos"), "mean": F.avg("v"), "max": F.max("v")}[how]
    return acts.groupBy("sample", "unit").agg(agg.alias("v"))


def predicted_labels(points: DataFrame) -> DataFrame:
    """(id, label): place of the largest output; for a single output whether it exceeds one half."""
    top = F.array_position("x", F.array_max("x")) - 1
    return points.select("id", F.when(F.size("x") == 1, (F.col("x")[0] > 0.5).cast("long")).otherwise(top).alias("label"))
