"""All pairs of vectors in tiles, and what is taken from them: trees, closest pairs, exact neighbours.

Points fall into tiles by a hash, as large as a task can well hold, or smaller where that gives too few tasks. A task
holds two tiles and compares each with the other, or one with itself. Only the
tasks' results leave them: a forest, the best pairs or the best neighbours, except where all pairs are asked. Where few of the distances are
kept, blocks of matrix products find those that may be, and only these are computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.vectors import Metric, metric, prepare
from graftline.operators import near
from graftline.operators.msf import EDGE, msf
from graftline.session import materialize, parallelism

TILE_ROWS = 8192
LEAST_ROWS = 256
BLOCK = 512  # rows of one side of a matrix product


def tiles_of(n: int, tasks: int, tile_rows: int | None = None) -> int:
    """Tiles for ``n`` points: of ``TILE_ROWS`` at most, and enough for their pairs to occupy ``tasks``."""
    if tile_rows:
        return max(1, math.ceil(n / tile_rows))
    return max(1, math.ceil(n / TILE_ROWS), min(math.ceil(n / LEAST_ROWS), math.ceil(math.sqrt(2 * tasks))))


def scores(x: np.ndarray, y: np.ndarray, m: Metric) -> tuple[np.ndarray, float]:
    """Numbers in the order of the distances between prepared rows, by a matrix product, and how far off they may be."""
    product = x @ y.T
    if m.unit:
        return -product, 1e-12
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return a[:, None] + b - 2 * product, 1e-12 * float(a.max(initial=0) + b.max(initial=0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or len(set(sizes.tolist())) > 1:
        raise ValueError("every vector must have the same number of elements")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def tiled(points: DataFrame, run: Callable[[int, int, pa.Table], pa.Table], schema: str, tile_rows: int | None = None, by: str | None = None) -> DataFrame:
    """Apply ``run(lo, hi, rows)`` to every pair of tiles lo <= hi of ``vec_id, embedding``; ``tile`` tells which
    tile a row is of. With ``by``, tiles are formed within each value of that column."""
    tiles = tiles_of(points.count(), parallelism(points.sparkSession), tile_rows)
    tile = F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")
    cols = [F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding")] + ([F.col(by).alias("part")] if by else [F.lit(0).alias("part")])
    paired = points.select(*cols, tile.alias("tile")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    paired = paired.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("other")

    def apply(key, t):
        return run(key[1].as_py(), key[2].as_py(), t)

    return paired.groupBy("part", "lo", "hi").applyInArrow(apply, schema)


def _ordered(t: pa.Table, m: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by("vec_id")
    return t.column("vec_id").to_numpy(), t.column("tile").to_numpy(), prepare(matrix(t.column("embedding")), m)


def _pair_rows(lo: int, hi: int, t: pa.Table, m: Metric) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of a task, each in one task only, row by row."""
    ids, tile, x = _ordered(t, m)
    if lo == hi:
        for r in range(len(ids) - 1):
            yield np.full(len(ids) - r - 1, ids[r]), ids[r + 1 :], m.rows(x[r], x[r + 1 :])
        return
    a, b = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
    for r in a:
        yield np.minimum(ids[r], ids[b]), np.maximum(ids[r], ids[b]), m.rows(x[r], x[b])


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    i, j, w = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0), np.empty(0))
    return pa.table([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(w, pa.float64())], names=["i", "j", "w"])


def all_pairs(points: DataFrame, name: str, tile_rows: int | None = None) -> DataFrame:
    """``i, j, w`` of all pairs i < j."""
    m = metric(name)
    return tiled(points, lambda lo, hi, t: _edges(list(_pair_rows(lo, hi, t, m))), EDGE, tile_rows)


def _cells(points: DataFrame, reach: float) -> DataFrame:
    """``vec_id, rep, code``: cells of three projections of the rows at length 1, so wide that rows within ``reach`` share one: a row
    so near the upper side of its cell that it may reach over is also in the next."""
    width = 8 * reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("vec_id").to_numpy(), prepare(matrix(b.column("embedding")), metric("cosine"))
            sides = np.linalg.qr(np.random.default_rng(11).standard_normal((x.shape[1], min(3, x.shape[1]))))[0]
            at = x @ sides / width
            cell = np.floor(at).astype(np.int64)
            over = at - cell >= 1 - reach / width - 1e-6
            for up in np.ndindex(*(2,) * cell.shape[1]):
                rows = np.flatnonzero((over | (np.array(up) == 0)).all(axis=1))
                code = (cell[rows] + np.array(up)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * cell.shape[1], pa.int32()), pa.array(code, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(np.zeros(len(rows)), pa.int32()), lists], names=["vec_id", "rep", "code"])

    vectors = points.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return vectors.mapInArrow(run, "vec_id long, rep int, code array<long>")


def _closest_in_cells(points: DataFrame, k: int, digits: int | None) -> DataFrame | None:
    """The ``k`` closest pairs under the cosine metric if they are so close that few rows share a cell, else None.

    Rows at length 1 and cosine distance w are sqrt(2 w) apart, and no projection is further. So pairs up to a limit all share
    a cell; the pairs found are the closest if the k-th is within the limit.
    """
    from graftline.operators.buckets import bucket_closest
    from graftline.operators.candidates import level_load

    n, limit = points.count(), 0.0
    slack = 1e-12 if digits is None else 10.0**-digits
    while limit < 0.1:
        cells = materialize(_cells(points, math.sqrt(2 * (limit + slack)) + 1e-9), "cells")
        if level_load(cells, 3) > n * (n - 1) // 32:
            return None
        found = materialize(bucket_closest(cells, points, 3, "cosine", k, digits), "closest")
        row = found.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).first()
        if row.n == k and row.w <= limit:
            return found.orderBy("w", "i", "j")
        limit = row.w if row.n == k else max(100 * limit, 1e-6)
    return None


def closest_pairs(points: DataFrame, name: str, k: int, tile_rows: int | None = None, digits: int | None = None) -> DataFrame:
    """The ``k`` closest pairs by (w, i, j); a task passes on at most ``k``. With ``digits`` weights are rounded first. Where the
    closest are as near as copies under the cosine metric, only rows that share a cell are compared."""
    m = metric(name)
    if m.name == "cosine" and not tile_rows and (found := _closest_in_cells(points, k, digits)) is not None:
        return found

    def run(lo: int, hi: int, t: pa.Table) -> pa.Table:
        ids, tile, x = _ordered(t, m)
        a, b = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        margin = 0.0 if digits is None else 10.0**-digits
        for s in range(0, len(a), BLOCK):
            part = a[s : s + BLOCK]
            score, off = scores(x[part], x[b], m)
            if lo == hi:
                score[part[:, None] >= b] = np.inf
            if len(held[2]) == k:
                last = held[2][-1] + margin  # of the k-th so far, as a score
                most = 1 - last if m.name == "cosine" else math.cos(min(math.pi, last)) if m.unit else last
                bound = (-most if m.unit else most**2) + off
            else:
                bound = np.partition(score, k, axis=None)[k] + off + (2 * margin if m.unit else 2 * margin * (1 + margin)) if score.size > k else np.inf
            r, c = np.nonzero((score <= bound) & np.isfinite(score))
            if len(r):
                p, q = part[r], b[c]
                w = np.concatenate([m.rows(x[p[n : n + 100_000]], x[q[n : n + 100_000]]) for n in range(0, len(p), 100_000)])
                w = w if digits is None else np.round(w, digits) + 0.0
                held = _least([held, (np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), w)], k)
        return _edges([held])

    return tiled(points, run, EDGE, tile_rows).orderBy("w", "i", "j").limit(k)


def _least(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, w = (np.concatenate(c) for c in zip(*parts, strict=True))
    keep = np.lexsort((j, i, w))[:k]
    return i[keep], j[keep], w[keep]


def dense_tree(ids: np.ndarray, x: np.ndarray, m: Metric, apart: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of all pairs of rows sorted by id, in the total order (w, i, j). With ``apart`` only
    pairs count that differ in every label, and the result may be a forest."""
    n = len(ids)
    outside = np.ones(n, bool)
    best, lo, hi = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)  # best is infinite inside
    out, now = [], 0
    for _ in range(n - 1):
        outside[now] = False
        reach = outside
        for label in apart or ():
            reach = reach & (label != label[now])
        rest = np.flatnonzero(reach)
        d = m.rows(x[now], x[rest])
        old = best[rest]
        closer = d <= old
        at, d, old = rest[closer], d[closer], old[closer]
        a, b = np.minimum(now, at), np.maximum(now, at)
        better = (d < old) | (a < lo[at]) | ((a == lo[at]) & (b < hi[at]))
        at = at[better]
        best[at], lo[at], hi[at] = d[better], a[better], b[better]
        now = int(best.argmin())
        least = best[now]
        if np.isinf(least):  # nothing left to reach: a new tree
            now = int(outside.argmax())
            continue
        ties = np.flatnonzero(best == least)
        if len(ties) > 1:
            now = int(ties[np.lexsort((hi[ties], lo[ties]))[0]])
        out.append((lo[now], hi[now], least))
        best[now] = np.inf
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    i, j, w = (np.array(c) for c in zip(*out, strict=True))
    return ids[i], ids[j], w


def exact_tree(points: DataFrame, name: str, tile_rows: int | None = None) -> DataFrame:
    """Exact minimum spanning tree ``i, j, w`` over all pairs: a tree per tile and per pair of tiles, merged. Points of
    few dimensions are merged where they are equal, and their tiles are large, as not all pairs are compared there."""
    m = metric(name)

    def run(lo: int, hi: int, t: pa.Table) -> pa.Table:
        ids, tile, x = _ordered(t, m)
        if near.is_near(x, m):
            return _edges([near.near_tree(ids, x)])
        # pairs within a tile are compared where lo = hi
        return _edges([dense_tree(ids, x, m, None if lo == hi else [tile])])

    parts = near.merged(points, name)
    if parts:
        places, stars = parts
        return msf(tiled(places, run, EDGE, tile_rows or near.ROWS).distinct(), places.count()).unionByName(stars)
    return msf(tiled(points, run, EDGE, tile_rows).distinct(), points.count())


def exact_trees_by(points: DataFrame, name: str, by: str, tile_rows: int | None = None) -> DataFrame:
    """The forest of the exact trees within each value of ``by``; rows with a null there are left out."""
    m = metric(name)

    def run(lo: int, hi: int, t: pa.Table) -> pa.Table:
        ids, tile, x = _ordered(t, m)
        # pairs within a tile are compared where lo = hi
        return _edges([dense_tree(ids, x, m, None if lo == hi else [tile])])

    known = points.filter(F.col(by).isNotNull())
    return msf(tiled(known, run, EDGE, tile_rows, by).distinct(), known.count())


def exact_neighbours(queries: DataFrame, points: DataFrame, name: str, k: int, keep_self: bool = False, block_rows: int = 512) -> DataFrame:
    """``query_id, rank, id, dist``: the ``k`` nearest points of each query by (dist, id).

    Queries are cut into blocks and every block meets every partition of the points once; a task passes on at
    most ``k`` rows per query. ``keep_self`` leaves a point of the query's own id in.
    """
    m = metric(name)
    blocks = max(1, math.ceil(queries.count() / block_rows))
    asked = queries.select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<float>").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"))
    n = points.count()
    parts = max(1, math.ceil(n / (4 * TILE_ROWS)), min(math.ceil(n / LEAST_ROWS), math.ceil(parallelism(points.sparkSession) / blocks)))
    left = asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = points.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("p"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a, b):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            q, ids = a.column("q").to_numpy(), b.column("id").to_numpy()
            x, y = prepare(matrix(a.column("v")), m), prepare(matrix(b.column("v")), m)
            for s in range(0, len(q), BLOCK):
                score, off = scores(x[s : s + BLOCK], y, m)
                if not keep_self:
                    score[q[s : s + BLOCK, None] == ids] = np.inf
                last = np.partition(score, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(score), np.inf)
                r, c = np.nonzero((score <= (last + 2 * off)[:, None]) & np.isfinite(score))
                if not len(r):
                    continue
                d = m.rows(x[s + r], y[c])
                order = np.lexsort((ids[c], d, r))
                r, c, d = r[order], c[order], d[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                good = rank < k
                out.append((q[s + r[good]], ids[c[good]], d[good]))
        return _edges(out).rename_columns(["query_id", "id", "dist"])

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(run, "query_id long, id long, dist double")
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def all_pairs_with(new: DataFrame, points: DataFrame, name: str, block_rows: int = 512) -> DataFrame:
    """Forest ``i, j, w`` of the pairs of new points with all points, per block; enough for a spanning tree."""
    from graftline.operators.msf import forest

    m = metric(name)
    blocks = max(1, math.ceil(new.count() / block_rows))
    parts = max(1, math.ceil(points.count() / (4 * TILE_ROWS)))
    left = new.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = points.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("p")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a, b):
        out = []
        if a.num_rows and b.num_rows:
            q, ids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            x, y = prepare(matrix(a.column("embedding")), m), prepare(matrix(b.column("embedding")), m)
            held = 0
            for r in range(len(q)):
                other = np.flatnonzero(ids != q[r])
                out.append((np.minimum(ids[other], q[r]), np.maximum(ids[other], q[r]), m.rows(x[r], y[other])))
                held += len(other)
                if held > 1_000_000 or r == len(q) - 1:
                    i, j, w = (np.concatenate(c) for c in zip(*out, strict=True))
                    keep = forest(i, j, w)
                    out, held = [(i[keep], j[keep], w[keep])], len(keep)
        return _edges(out)

    return left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(run, EDGE)
