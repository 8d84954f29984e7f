"""Pruning neighbour search: the rows of the plain one, with few comparisons on clustered data."""

import numpy as np
import pytest

from strataloom.operators import points as pt, pruned as pr


def _cloud(spark, seed=0, n=1200, dims=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dims)) * 50
    x = centres[r.integers(40, size=n)] + r.normal(size=(n, dims))
    x[:5] = x[5]  # copies
    x[7] = 1e4  # far from all
    return spark.createDataFrame([(i, np.round(v, 6).tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, part int").repartition(3)


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_rows_are_those_of_the_plain_search(spark, metric):
    points = _cloud(spark)
    key = lambda df: sorted((r.i, r["rank"], r.j, round(r.d, 9)) for r in df.collect())
    assert key(pr.nearest(points, 6, metric, pivots=60, block=64)) == key(pt.nearest(points, 6, metric))


def test_few_comparisons_on_clusters(spark):
    points = _cloud(spark, 1, 3000)
    assert pr.comparisons(points, 5, pivots=120, block=100) < 3000**2 / 10


def test_small_clouds_and_other_distances(spark):
    for n in (1, 2, 7):
        points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)], "id long, x array<double>")
        assert sorted(map(tuple, pr.nearest(points, 3).collect())) == sorted(map(tuple, pt.nearest(points, 3).collect()))
    assert pr.nearest(points.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="triangle"):
        pr.nearest(points, 3, "cosine")
