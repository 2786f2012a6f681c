"""Spanning trees of points of few dimensions: rounds of nearest other components over boxes, instead of all pairs.

Points are halved along their widest side down to leaves of ``LEAF``. In every round each component takes the least edge, by (w, i, j),
to another one; a box is opened only if it may hold such an edge. Rounding is monotone, so the distance between two boxes,
computed like that of two points, never exceeds that of points inside, and nothing is lost to it. Of equal points all but the
least id hang on that id at distance 0, which is what the total order asks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.vectors import Metric
from graftline.operators.msf import roots
from graftline.session import materialize

DIMS = 4  # most dimensions; beyond them boxes overlap too much to leave out many
LEAF = 8
LEAST = 256  # rows below which all pairs are less work
ROWS = 1 << 19  # rows of a tile
FRONT = 200_000  # pairs of boxes looked at once


def is_near(x: np.ndarray, m: Metric) -> bool:
    return m.name == "euclidean" and len(x) >= LEAST and 0 < x.shape[1] <= DIMS and bool(np.isfinite(x).all())


def few(points: DataFrame, name: str) -> bool:
    """Whether the points have so few dimensions."""
    size = points.select(F.size("embedding").alias("n")).first() if name == "euclidean" else None
    return size is not None and 0 < size.n <= DIMS


def merged(points: DataFrame, name: str) -> tuple[DataFrame, DataFrame] | None:
    """Of points of few dimensions those with the least id at their place, and the edges ``i, j, w`` of the others to them."""
    if not few(points, name):
        return None
    flat = materialize(points.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")), "points")
    places = materialize(flat.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding"), "places")
    first = places.select(F.col("vec_id").alias("i"), F.col("embedding").alias("place"))
    stars = flat.join(first, F.col("embedding") == F.col("place")).filter("vec_id <> i").select("i", F.col("vec_id").alias("j"), F.lit(0.0).alias("w"))
    return places, materialize(stars, "stars")


def near_tree(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of rows sorted by id under the euclidean distance, in the total order (w, i, j)."""
    order = np.lexsort((np.arange(len(ids)), *x.T))
    new = np.r_[True, (x[order[1:]] != x[order[:-1]]).any(axis=1)]
    first = order[new]
    owner = first[np.cumsum(new) - 1]
    copies = ~new
    a, b = owner[copies], order[copies]
    places = np.sort(first)
    i, j, w = _tree(x[places])
    return ids[np.r_[a, places[i]]], ids[np.r_[b, places[j]]], np.r_[np.zeros(len(a)), w]


def _layout(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows in the order of the leaves, and how often they were halved."""
    n = len(x)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    perm = np.arange(n)
    for level in range(depth):
        starts = (np.arange(1 << level) * n) >> level
        part = np.repeat(np.arange(1 << level), np.diff(np.r_[starts, n]))
        y = x[perm]
        side = (np.maximum.reduceat(y, starts) - np.minimum.reduceat(y, starts)).argmax(axis=1)
        perm = perm[np.lexsort((y[np.arange(n), side[part]], part))]
    return perm, depth


def _lengths(d: np.ndarray) -> np.ndarray:
    return np.sqrt((d**2).sum(axis=-1))


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of different rows, as positions."""
    n = len(x)
    perm, depth = _layout(x)
    y = x[perm]
    starts = (np.arange(1 << depth) * n) >> depth
    sizes = np.diff(np.r_[starts, n])
    slot = np.arange(sizes.max(initial=1))
    held = np.where(slot < sizes[:, None], starts[:, None] + slot, n)  # n stands for no row
    rows = np.vstack([y, np.full((1, x.shape[1]), np.nan)])[held]
    low, high = [np.minimum.reduceat(y, starts)], [np.maximum.reduceat(y, starts)]
    for _ in range(depth):
        low.insert(0, np.minimum(low[0][0::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][0::2], high[0][1::2]))

    comp, out = np.arange(n), []
    while comp.max(initial=0) > 0:
        bound = np.full(comp.max() + 1, np.inf)
        for step in (1, 2, 3):
            w = _lengths(y[step:] - y[:-step])
            apart = comp[step:] != comp[:-step]
            np.minimum.at(bound, comp[step:][apart], w[apart])
            np.minimum.at(bound, comp[:-step][apart], w[apart])
        # of every box its only component, or -1
        only = [np.where((a := np.minimum.reduceat(comp, starts)) == np.maximum.reduceat(comp, starts), a, -1)]
        for _ in range(depth):
            only.insert(0, np.where(only[0][0::2] == only[0][1::2], only[0][0::2], -1))
        comp_of = np.r_[comp, 0][held]
        found = []
        leaves = np.arange(len(starts))
        stack = [(0, leaves, np.zeros(len(leaves), np.int64))]
        while stack:
            level, q, box = stack.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                stack += [(level, q[half:], box[half:]), (level, q[:half], box[:half])]
                continue
            gap = np.maximum(np.maximum(low[level][box] - high[depth][q], low[depth][q] - high[level][box]), 0.0)
            reach = np.where(held[q] < n, bound[comp_of[q]], 0.0).max(axis=1)
            mixed = (only[depth][q] < 0) | (only[depth][q] != only[level][box])
            keep = (_lengths(gap) <= reach) & mixed
            q, box = q[keep], box[keep]
            if not len(q):
                continue
            if level < depth:
                stack.append((level + 1, np.repeat(q, 2), (box[:, None] * 2 + np.arange(2)).ravel()))
                continue
            for s in range(0, len(q), 20_000):
                a, b = q[s : s + 20_000], box[s : s + 20_000]
                w = _lengths(rows[a][:, :, None, :] - rows[b][:, None, :, :])
                ca = comp_of[a][:, :, None]
                at, left, right = np.nonzero((w <= bound[ca]) & (ca != comp_of[b][:, None, :]))
                w, p, r = w[at, left, right], held[a[at], left], held[b[at], right]
                np.minimum.at(bound, comp[p], w)
                good = w <= bound[comp[p]]
                found.append((comp[p[good]], w[good], perm[p[good]], perm[r[good]]))
        c, w, p, r = (np.concatenate(f) for f in zip(*found, strict=True))
        good = w <= bound[c]
        c, w, p, r = c[good], w[good], p[good], r[good]
        i, j = np.minimum(p, r), np.maximum(p, r)
        at = np.lexsort((j, i, w, c))
        at = at[np.r_[True, c[at][1:] != c[at][:-1]]]
        c, w, i, j, r = c[at], w[at], i[at], j[at], r[at]
        place = np.empty(n, np.int64)
        place[perm] = comp
        parent = place[r]  # every component has an edge, and c counts them all
        mutual = c[(parent[parent] == c) & (c < parent)]
        parent[mutual] = mutual
        _, comp = np.unique(roots(parent)[comp], return_inverse=True)
        out.append((i, j, w))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    i, j, w = (np.concatenate(o) for o in zip(*out, strict=True))
    _, at = np.unique(i * n + j, return_index=True)
    return i[at], j[at], w[at]
