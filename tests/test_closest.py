"""Closest pairs by cells: those of all pairs, from few of them."""

import numpy as np
import pytest

from graftline.operators import pairs


def frame(spark, x):
    return spark.createDataFrame([(n, [float(e) for e in v]) for n, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("noise", [0.0, 1e-4, 1e-2])
def test_cells_find_the_closest(spark, noise):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 20)).astype(np.float32)
    x = np.vstack([x, x[:40] * 2 + noise * rng.standard_normal((40, 20))])
    points = frame(spark, x)
    want = pairs.closest_pairs(points, "cosine", 30, tile_rows=400, digits=9).collect()
    found = pairs._closest_in_cells(points, 30, 9)
    assert found is not None and sorted(found.collect()) == sorted(want)


def test_all_pairs_where_cells_are_full(spark):
    x = np.random.default_rng(4).standard_normal((60, 20))
    points = frame(spark, x)
    assert pairs._closest_in_cells(points, 30, 9) is None
    assert pairs.closest_pairs(points, "cosine", 30, digits=9).collect() == pairs.closest_pairs(points, "cosine", 30, tile_rows=20, digits=9).collect()
