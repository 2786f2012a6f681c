"""Trees of points of few dimensions: the same as of all pairs, without comparing them."""

import numpy as np
import pytest

from graftline.functions.families import E2LSH
from graftline.functions.vectors import metric
from graftline.operators import near, pairs, tree

M = metric("euclidean")


def crowd(n, seed=0):
    """Points on a grid of 12 by 30, so that most are copies and most distances tie."""
    rng = np.random.default_rng(seed)
    return np.c_[rng.integers(0, 12, n) * 2.0, rng.integers(0, 30, n) / 8]


def edges(i, j, w):
    return sorted(zip(np.asarray(i).tolist(), np.asarray(j).tolist(), np.asarray(w).tolist(), strict=True))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(a), [float(e) for e in v]) for a, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["even", "ties", "far apart", "equal", "line"])
def test_tree_equals_that_of_all_pairs(dims, kind):
    rng, n = np.random.default_rng(dims), 700
    x = {
        "even": rng.random((n, dims)),
        "ties": rng.integers(0, 9, (n, dims)).astype(float),
        "far apart": np.vstack([rng.random((n // 2, dims)), rng.random((n // 2, dims)) * 0.01 + 50]),
        "equal": np.zeros((n, dims)),
        "line": np.c_[np.arange(n, dtype=float), np.zeros((n, dims - 1))],
    }[kind]
    ids = np.sort(rng.choice(10_000, n, replace=False))
    assert edges(*near.near_tree(ids, x)) == edges(*pairs.dense_tree(ids, x, M))


def test_few_rows():
    for n in (1, 2, 3):
        x = np.arange(2.0 * n).reshape(n, 2)
        assert edges(*near.near_tree(np.arange(n), x)) == edges(*pairs.dense_tree(np.arange(n), x, M))


@pytest.mark.parametrize("tile_rows", [None, 150])
def test_exact_tree_merges_copies(spark, tile_rows):
    x = crowd(1500)
    points = frame(spark, range(len(x)), x)
    places, stars = near.merged(points, "euclidean")
    assert places.count() == len(np.unique(x, axis=0)) and places.count() + stars.count() == len(x)
    got = pairs.exact_tree(points, "euclidean", tile_rows).toPandas()
    assert edges(got.i, got.j, got.w) == edges(*pairs.dense_tree(np.arange(len(x)), x, M))


FAMILY = E2LSH(2, 12, 4, width=8.0)


def crowded(spark):
    x = crowd(1500)
    return x, frame(spark, range(len(x)), x), edges(*pairs.dense_tree(np.arange(len(x)), x, M))


def test_found_tree_hashes_one_point_of_a_place(spark):
    x, points, want = crowded(spark)
    found = tree.find_tree(points, FAMILY)
    got = found.edges.toPandas()
    assert edges(got.i, got.j, got.w) == want
    places = len(np.unique(x, axis=0))
    # with its copies it would compare them in each of the tables
    assert found.levels[0]["compared"] <= places * (places - 1) // 2


def test_figures_count_the_copies(spark):
    x, points, want = crowded(spark)
    found = tree.find_tree(points, FAMILY)
    last = found.metrics().filter("accepted").first()
    assert last.n_edges == len(x) - 1 and last.weight == pytest.approx(sum(w for _, _, w in want))
    assert last.compared <= len(np.unique(x, axis=0)) ** 2 // 2


def test_pruned_tree_keeps_the_copies(spark):
    x, points, want = crowded(spark)
    found = tree.find_tree(points, FAMILY, prune_connected=True)
    got = found.edges.toPandas()
    assert edges(got.i, got.j, got.w) == want and found.levels[0]["compared"] <= len(np.unique(x, axis=0)) ** 2 // 2


def test_epsilon_tree_keeps_the_copies(spark):
    x, points, want = crowded(spark)
    found = tree.find_epsilon_tree(points, FAMILY, epsilon=0.2)
    got = found.edges.toPandas()
    assert len(got) == len(x) - 1 and got.w.sum() <= 1.2 * sum(w for _, _, w in want)
    assert found.levels[0]["compared"] <= len(np.unique(x, axis=0)) ** 2 // 2
