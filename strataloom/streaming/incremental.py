"""Incremental results over streams of snapshots."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernels import distance_block, magnitude_slope, two_nn_dimension


def streaming_class_means(diagrams: DataFrame) -> DataFrame:
    """Running sums and counts of labelled diagram values (layer_idx, label, pos, v); update or complete mode, no watermark needed as sums don't age."""
    return diagrams.groupBy("layer_idx", "label", "pos").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))


def windowed_series(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """(start, event_type, n, mean) of events (ts, event_type, value) in sliding windows; events later than late are dropped."""
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def rolling_snapshots(values: DataFrame, window: int, stride: int, late: int = 0) -> DataFrame:
    """(win, coord, n, mean, std) of a stream of snapshots (step, coord, v) in every window of so many consecutive steps.

    Steps are counted as seconds of event time, so Spark's sliding windows and watermark apply:
    a window is final once a step more than late beyond its end has come; win is its first step.
    """
    t = values.withColumn("_t", F.timestamp_seconds("step")).withWatermark("_t", f"{late} seconds")
    w = F.window("_t", f"{window} seconds", f"{stride} seconds")
    out = t.groupBy(w, "coord").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.select(F.unix_timestamp("window.start").alias("win"), "coord", "n", "mean", "std")


#: Dimensions of a window's points by name.
DIMENSIONS: dict[str, Callable[[np.ndarray], float]] = {
    "two_nn": lambda x: two_nn_dimension(distance_block(x, x)), "magnitude": lambda x: magnitude_slope(distance_block(x, x)),
}


def rolling_dimension(snapshots: DataFrame, window: int, stride: int = 1, how: str | Callable[[np.ndarray], float] = "two_nn", late: int = 0, idle: int | None = None) -> DataFrame:
    """(key, win, centre, dimension, dropped) of a stream of snapshots (key, step, x): the dimension of every window of so many snapshots of a key.

    Windows go by the number of snapshots, whatever the gaps between their steps: win counts
    the snapshots before the first, centre is the step in the middle.  The state of a key is
    its last snapshots, `window` and those not yet settled.  A snapshot settles once `late`
    further ones with greater steps have come, or, with idle, after so many seconds without
    any; one that comes after its step or a greater one has settled is dropped and counted.  Of
    snapshots with one step the first counts.  how: two_nn, magnitude or a function of the points.
    Append mode; the result is that of windowed_dimension over the settled snapshots.
    """
    measure = DIMENSIONS[how] if isinstance(how, str) else how

    def settle(key: tuple, state: GroupState, keep: int, fresh: list[tuple[int, list[float]]]) -> list[tuple]:
        done, held, waiting, dropped = pickle.loads(state.get[0]) if state.exists else (0, [], {}, 0)
        last = held[-1][0] if held else None
        for step, x in fresh:
            if last is not None and step <= last:
                dropped += 1
            else:
                waiting.setdefault(step, x)
        rows = []
        for step in sorted(waiting)[: max(0, len(waiting) - keep)]:
            held = [*held[-(window - 1) :], (step, waiting.pop(step))] if window > 1 else [(step, waiting.pop(step))]
            done += 1
            first = done - window
            if first >= 0 and first % stride == 0:
                rows.append((key[0], first, held[window // 2][0], float(measure(np.array([x for _, x in held], float))), dropped))
        state.update((pickle.dumps((done, held, waiting, dropped)),))
        if idle is not None and waiting:
            state.setTimeoutDuration(idle * 1000)
        return rows

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rows = settle(key, state, 0, [])
        else:
            fresh = [(int(s), [float(v) for v in x]) for b in batches for s, x in zip(b["step"], b["x"])]
            rows = settle(key, state, late, sorted(fresh, key=lambda s: s[0]))
        yield pd.DataFrame(rows, columns=["key", "win", "centre", "dimension", "dropped"])

    kind = snapshots.schema["key"].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    own = snapshots.select("key", F.col("step").cast("long").alias("step"), F.col("x").cast("array<double>").alias("x"))
    return own.groupBy("key").applyInPandasWithState(run, f"key {kind}, win long, centre long, dimension double, dropped long", "held binary", "append", timeout)
