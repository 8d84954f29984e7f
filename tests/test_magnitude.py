"""Magnitudes from blocks against the whole matrix."""

import numpy as np

from strataloom.functions import magnitude as mg
from strataloom.functions.kernels import distance_block, magnitude
from strataloom.operators import series as se


def test_large_bundles_equal_the_matrix(spark, monkeypatch):
    r = np.random.default_rng(9)
    clouds = {"wide": r.normal(size=(330, 40)), "flat": r.normal(size=(300, 2)), "copies": np.repeat(r.normal(size=(90, 5)), 3, axis=0)}
    monkeypatch.setattr(mg, "COLUMNS", 64)
    for x in clouds.values():
        d = distance_block(x, x)
        med = np.median(d[d > 0])
        assert abs(mg.median_distance(x) - med) < 1e-12 * med
        t = np.geomspace(0.01 / med, 100 / med, 7)
        np.testing.assert_allclose(mg.magnitudes(x, t), [magnitude(d, s) for s in t], rtol=1e-8)
    rows = [(b, k, v.tolist()) for b, x in clouds.items() for k, v in enumerate(x)]
    points = spark.createDataFrame([*rows, ("one", 0, [1.0, 2.0])], "bundle string, id long, x array<double>")
    a, b = ({r["bundle"]: (r["n"], round(r["dimension"], 6)) for r in se.magnitude_dimension(points, direct=n).collect()} for n in (1000, 100))
    one = a.pop("one"), b.pop("one")
    assert a == b and len(a) == 3 and np.isnan([v[1] for v in one]).all()
