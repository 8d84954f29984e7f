"""Exact nearest neighbours that skip what the triangle inequality rules out.

Every point goes to the nearest of a bounded number of pivots.  The k-th distance to points
of its own part bounds that to all, so a point is sent only to parts that can hold a point
so near: whose pivot is no further than the bound and the part's radius, and not beyond the
bound from the plane between the pivots (euclidean only).  On clustered data most parts
drop out; on data without structure every point meets every part, as in points.nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import distance_block
from ..sources.scratch import written
from .points import BLOCK, Nearest

#: Distances for which the triangle inequality holds.
METRICS = ("euclidean", "cityblock", "hamming", "mean_difference")
#: Pivots at most; each task holds them.
PIVOTS = 1024
_SLACK = 1e-9
#: Rows sent at a time.
_ROWS = 1 << 14


def _stacked(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float)


def _parts(points: DataFrame, metric: str, pivots: int, block: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(id, x, part, far): the nearest pivot of each point and the distance to it; and the pivots, those of the least hashes."""
    n = points.count()
    some = points.select("id", "x").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(1, min(pivots, -(-4 * n // block), n)))
    at = np.array([r["x"] for r in some.collect()], float)  # a stated number of rows

    def run(batches):
        for t in batches:
            if t.num_rows:
                d = distance_block(_stacked(t.column(1)), at, metric)
                p = d.argmin(axis=1)
                yield pa.record_batch({"id": t.column(0), "x": t.column(1), "part": pa.array(p.astype(np.int32)), "far": pa.array(d[np.arange(len(p)), p])})

    kind = points.schema["x"].dataType.simpleString()
    return written(points.select("id", "x").mapInArrow(run, f"id long, x {kind}, part int, far double"), "parts"), at


def _wanted(points: DataFrame, k: int, metric: str, pivots: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, x, part) of every point in every part that can hold one of its k nearest, and (id, x, part, b) of the points in blocks of their parts."""
    if metric not in METRICS:
        raise ValueError(f"{metric!r} need not obey the triangle inequality; known: {', '.join(METRICS)}")
    own, at = _parts(points, metric, pivots, block, seed)
    size = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    size = written(size, "sizes")  # a row a pivot
    radius = np.full(len(at), -np.inf)
    for r in size.collect():
        radius[r["part"]] = r["radius"]
    blocks = F.ceil(F.col("n") / block)
    dealt = own.join(F.broadcast(size.select("part", "n")), "part").withColumn("b", F.pmod(F.xxhash64("id"), blocks)).select("id", "x", "part", "far", "b")
    dealt = written(dealt, "dealt")

    def bound(t):
        x = _stacked(t["x"])
        ids, far = np.arange(len(x)), np.full(len(x), np.inf)
        if len(x) > k:
            near = Nearest(ids, x, k, metric)
            near.see(ids, x)
            i, _, rank, d = near.rows()
            far[i[rank == k]] = d[rank == k]
        return t.select(["id", "x", "part"]).append_column("bound", pa.array(far))

    kind = points.schema["x"].dataType.simpleString()
    held = dealt.groupBy("part", "b").applyInArrow(bound, f"id long, x {kind}, part int, bound double")

    def send(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, most = _stacked(t.column(1)), t.column(3).to_numpy()[:, None]
            d, p = distance_block(x, at, metric), t.column(2).to_numpy()
            reach = most * (1 + _SLACK) + _SLACK
            ok = d - radius[None, :] <= reach
            if metric == "euclidean":  # how far the plane between the two pivots is
                near = d[np.arange(len(p)), p][:, None]
                gap = distance_block(at, at, metric)[p]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ok &= np.where(gap > 0, (d**2 - near**2) / (2 * gap), 0) <= reach
            ok[np.arange(len(p)), p] = True
            row, part = np.nonzero(ok & np.isfinite(radius)[None, :])
            for s in range(0, len(row), _ROWS):
                rows = t.select(["id", "x"]).take(pa.array(row[s : s + _ROWS]))
                yield pa.record_batch({"id": rows.column(0), "x": rows.column(1), "part": pa.array(part[s : s + _ROWS].astype(np.int32))})

    return written(held.mapInArrow(send, f"id long, x {kind}, part int"), "wanted"), dealt.select("id", "x", "part", "b")


def comparisons(points: DataFrame, k: int, metric: str = "euclidean", pivots: int = PIVOTS, block: int = BLOCK, seed: int = 0) -> int:
    """How many distances between points nearest() here works out, those of the bounds too."""
    wanted, dealt = _wanted(points, k, metric, pivots, block, seed)
    size = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    inner = dealt.groupBy("part", "b").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    return inner + (wanted.groupBy("part").agg(F.count(F.lit(1)).alias("q")).join(size, "part").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0)


def nearest(points: DataFrame, k: int, metric: str = "euclidean", pivots: int = PIVOTS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(i, j, rank, d): the k nearest other points of each point of a cloud (id, x), ties by id; the same rows as points.nearest.

    A part of any size is cut into blocks, and so are the points sent to it; a cell compares
    one of each and keeps k rows a point.
    """
    wanted, dealt = _wanted(points, k, metric, pivots, block, seed)
    size = dealt.groupBy("part").agg((F.max("b") + 1).alias("blocks"))
    asked = wanted.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
    shape = written(size.join(asked, "part"), "shape")  # a row a pivot
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    q = wanted.join(F.broadcast(shape), "part").withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks"))).withColumn("b", every("blocks")).select("part", "b", "c", "id", "x", F.lit(True).alias("asks"))
    a = dealt.join(F.broadcast(shape), "part").withColumn("c", every("chunks")).select("part", "b", "c", "id", "x", F.lit(False).alias("asks"))

    def cell(t):
        asks = t["asks"].to_numpy()
        ids = t["id"].to_numpy()
        if asks.all() or not asks.any():
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        x, mine, other = _stacked(t["x"]), np.flatnonzero(asks), np.flatnonzero(~asks)
        near = Nearest(ids[mine], x[mine], k, metric)
        near.see(ids[other], x[other])
        i, j, _, v = near.rows()
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "d": pa.array(v, pa.float64())})

    found = q.unionByName(a).groupBy("part", "b", "c").applyInArrow(cell, "i long, j long, d double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("i", "j", "rank", "d")
