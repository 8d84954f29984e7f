"""Masked forward passes, labelled complexes and rolling dimensions of streams, against NumPy and the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions.kernels import distance_block, rips
from strataloom.operators import forward as fw, points as pt, training as tr
from strataloom.plans.analysis import Analysis
from strataloom.streaming.incremental import rolling_dimension


@pytest.mark.parametrize("block", [3, 512])
def test_forward_equals_numpy(spark, block):
    r = np.random.default_rng(0)
    x, sizes = r.normal(size=(23, 7)), (7, 11, 5)
    ws = [r.normal(size=s) for s in zip(sizes, sizes[1:])]
    bs = [r.normal(size=s) for s in sizes[1:]]
    masks = [r.random(w.shape) < 0.6 for w in ws]
    y = r.integers(5, size=23)
    inputs = spark.createDataFrame([(s, i, float(v)) for (s, i), v in np.ndenumerate(x)], "sample long, i long, a double")
    weights = spark.createDataFrame([(k, i, j, float(v)) for k, w in enumerate(ws) for (i, j), v in np.ndenumerate(w)], "layer_idx int, i long, j long, w double")
    biases = spark.createDataFrame([(k, j, float(v)) for k, b in enumerate(bs) for j, v in enumerate(b)], "layer_idx int, j long, b double")
    kept = spark.createDataFrame([(k, i, j, bool(v)) for k, m in enumerate(masks) for (i, j), v in np.ndenumerate(m) if not v or (i + j) % 2], "layer_idx int, i long, j long, kept boolean")
    labels = spark.createDataFrame([(s, int(v)) for s, v in enumerate(y)], "sample long, label long")
    for own, act, f in ((ws, "relu", lambda z: np.maximum(z, 0)), ([w * m for w, m in zip(ws, masks)], "tanh", np.tanh)):
        out = f(x @ own[0] + bs[0]) @ own[1] + bs[1]
        m = None if own is ws else kept
        w = weights if m is None else fw.apply_masks(weights, m)
        got = np.zeros_like(out)
        for row in fw.forward(inputs, w, [0, 1], biases, act, block=block).collect():
            got[row.sample, row.i] = row.a
        assert np.allclose(got, out)
        n, correct, share = fw.pruned_accuracy(inputs, labels, weights, m, [0, 1], biases, act).first()
        assert n == 23 and correct == (out.argmax(axis=1) == y).sum() and share == pytest.approx(correct / 23)
    assert fw.accuracy(fw.forward(inputs.limit(0), weights, [0, 1]), labels).first().n == 0


def _labelled(spark, seed=1):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(40, 2)), r.normal(size=(30, 2)) + 1.5])
    y = np.r_[np.zeros(40, int), np.ones(30, int)]
    return x, y, spark.createDataFrame([("all", i, v.tolist(), int(c), 1) for i, (v, c) in enumerate(zip(x, y))], "bundle string, id long, x array<double>, label long, d int")


@pytest.mark.parametrize("scale", ["global", "local"])
@pytest.mark.parametrize("gamma", [None, 0.9])
def test_labelled_complex_equals_numpy(spark, scale, gamma):
    x, y, points = _labelled(spark)
    for source, metric in ((0, "euclidean"), (1, "cityblock")):
        s, w = np.flatnonzero(y == source), np.flatnonzero(y != source)
        gap = distance_block(x[s], x[w], metric).min(axis=1)
        s = s[gap <= (np.quantile(gap, 0.5) if gamma is None else gamma)]
        d = distance_block(x[s], x[s], metric)
        if scale == "local":
            r = np.sort(d, axis=1)[:, min(5, len(s) - 1)]
            d = d / np.sqrt(np.outer(r, r))
        got = {(e.i, e.j): e.d for e in pt.labelled_complex(points, source, gamma=gamma, scale=scale, metric=metric, block=16).collect()}
        want = {(int(s[a]), int(s[b])): d[a, b] for a in range(len(s)) for b in range(a + 1, len(s))}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    small = pt.labelled_complex(points, source, gamma=gamma, scale=scale, metric=metric, most=1.0)
    assert small.count() == sum(v <= 1 for v in want.values())


def test_labelled_complex_in_an_analysis(spark):
    x, y, points = _labelled(spark, 2)
    options = {"quantile": 0.8, "scale": "local", "k_local": 3}
    bars = Analysis("labelled_complex_graph", "ph", options, {"max_dim": 1}).fit(points)
    pairs = pt.labelled_complex(points, 0, 0.8, scale="local", k_local=3).collect()
    at = {i: k for k, i in enumerate(sorted({p.i for p in pairs} | {p.j for p in pairs}))}
    d = np.zeros((len(at), len(at)))
    for p in pairs:
        d[at[p.i], at[p.j]] = d[at[p.j], at[p.i]] = p.d
    assert np.allclose(sorted((b.dim, b.birth, b.death) for b in bars.filter("death < 1e300").collect()), sorted(b for b in rips(d, 1) if np.isfinite(b[2])))
    with pytest.raises(ValueError, match="two labels"):
        pt.labelled_complex(points.filter("label = 0"))
    with pytest.raises(ValueError, match="raise gamma"):
        pt.labelled_complex(points, gamma=0.0)
    with pytest.raises(ValueError, match="unknown scale"):
        pt.labelled_complex(points, scale="other")


def _drain(spark, at, to, checkpoint, **how):
    stream = spark.readStream.schema("key string, step long, x array<double>").option("maxFilesPerTrigger", 1).parquet(at)
    query = rolling_dimension(stream, **how).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_rolling_dimension_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    """Gaps in the steps, steps out of order, a late one, a repeated one, and a restart halfway."""
    r = np.random.default_rng(6)
    steps = np.cumsum(r.integers(1, 9, size=24)).tolist()
    rows = [(key, s, r.normal(size=3).tolist()) for s in steps for key in ("a", "b")]
    order = list(range(48))
    for i in range(4, 40, 6):
        order[i], order[i + 2] = order[i + 2], order[i]  # neighbours in time, one step late
    files = [[rows[i] for i in order[k : k + 12]] for k in range(0, 48, 12)]
    files[3].append(("a", steps[2] - 1 if steps[2] - 1 not in steps else steps[0] - 1, [9.0, 9.0, 9.0]))  # far too late
    files[1].append(rows[order[3]])  # a step again
    at, to, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for k, part in enumerate(files):
        spark.createDataFrame(part, "key string, step long, x array<double>").coalesce(1).write.mode("append").parquet(at)
        if k in (1, 3):
            _drain(spark, at, to, checkpoint, window=6, stride=2, late=2)
    got = spark.read.parquet(to)
    for key in ("a", "b"):
        settled = sorted(steps)[:-2]  # two may still come late
        flat = [(s, c, v) for k, s, x in rows if k == key and s in settled for c, v in enumerate(x)]
        want = tr.windowed_dimension(spark.createDataFrame(flat, "step long, coord int, v double"), 6, 2, "two_nn")
        one = {w.win: (w.centre, w.dimension) for w in want.collect()}
        mine = {w.win: (w.centre, w.dimension) for w in got.filter(F.col("key") == key).collect()}
        assert mine.keys() == one.keys() and len(mine) >= 8
        assert all(mine[w][0] == one[w][0] and mine[w][1] == pytest.approx(one[w][1]) for w in one)
    assert {r.key: r.d for r in got.groupBy("key").agg(F.max("dropped").alias("d")).collect()} == {"a": 1, "b": 1}  # the late one, and the one that came again
