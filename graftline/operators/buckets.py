"""Work within hash buckets: spanning trees and closest pairs of the points that share a prefix in a table.

A point goes to its bucket of every table with its vector, if others are there, and the pairs of a bucket are compared there, so no
pair ever travels. Buckets above ``TILE_ROWS`` are cut into tiles whose pairs are tasks of their own. Buckets of
a table are disjoint, and forests compose, so what leaves a bucket is its own tree or its own best pairs.

With ``new`` only pairs count whose next symbols differ: those that first meet at this prefix in the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.families import Family, codes
from graftline.functions.vectors import Metric, metric, prepare
from graftline.operators import near
from graftline.operators.candidates import prefix_of
from graftline.operators.pairs import dense_tree, matrix
from graftline.session import materialize, parallelism

TILE_ROWS = 2048
SMALL = 48  # rows of buckets whose pairs are listed at once
HOLD = 65_536  # rows gathered before they are worked on
LIST = 1_000_000  # pairs listed at once


def hashed(points: DataFrame, family: Family) -> DataFrame:
    """``vec_id, rep, code``, written once for all prefixes."""
    return materialize(codes(points, family), "hashed")


def placed(table: DataFrame, points: DataFrame, prefix: int, new: bool, tile_rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of buckets with at least two points, once for each task they belong to, sorted by task, with their vectors."""
    child = F.element_at("code", prefix + 1) if new else F.col("vec_id")
    keyed = table.select("vec_id", "rep", F.xxhash64("rep", prefix_of("code", prefix)).alias("bucket"), child.alias("child"), *extra)
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("_a"), F.max("child").alias("_b")).filter("n > 1 and _a <> _b").select("bucket", "n")
    tiles = F.ceil(F.col("n") / tile_rows).cast("int")
    vectors = points.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    some = keyed.join(sizes, "bucket").join(vectors, "vec_id").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    spread = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "rep", "vec_id", "child", *extra, "embedding")
    return spread.repartition(4 * parallelism(table.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "vec_id")


def _listed(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within runs, in parts."""
    for size in np.unique(sizes):
        a, b = np.triu_indices(size, 1)
        if not len(a):
            continue
        at = starts[sizes == size]
        step = max(1, LIST // len(a))
        for s in range(0, len(at), step):
            yield (at[s : s + step, None] + a).ravel(), (at[s : s + step, None] + b).ravel()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal (bucket, lo, hi), with the first row of each."""
    held: list[pa.Table] = []
    rows = 0

    def cut(t: pa.Table) -> np.ndarray:
        keys = [t.column(n).to_numpy() for n in range(3)]
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(change)

    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
        if rows >= HOLD:
            t = pa.concat_tables(held).combine_chunks()
            starts = cut(t)
            last = int(starts[-1])
            if last:
                yield t.slice(0, last), starts[:-1]
            held = [t.slice(last)]
            rows = t.num_rows - last
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, cut(t)


def _work(m: Metric, labels: tuple[str, ...], keep: Callable, whole: Callable):
    """``keep(i, j, w, rep)`` reduces listed pairs, ``whole(ids, x, labels)`` gives the pairs of one larger run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches):
            ids, rep, bucket = (t.column(c).to_numpy() for c in ("vec_id", "rep", "bucket"))
            x = prepare(matrix(t.column("embedding")), m)
            across = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            # rows of one tile are compared where lo = hi, so elsewhere the tile is a label that must differ
            tile = np.where(across, t.column("tile").to_numpy(), ids)
            apart = [t.column(c).to_numpy() for c in labels] + [tile]
            sizes = np.diff(np.r_[starts, t.num_rows])
            for a, b in _listed(starts[sizes <= SMALL], sizes[sizes <= SMALL]):
                fit = np.ones(len(a), bool)
                for label in apart:
                    fit &= label[a] != label[b]
                a, b = a[fit], b[fit]
                if len(a):
                    yield _batch(*keep(ids[a], ids[b], m.rows(x[a], x[b]), bucket[a], rep[a]))
            for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                i, j, w = whole(ids[s : s + n], x[s : s + n], [label[s : s + n] for label in apart])
                if len(i):
                    yield _batch(i, j, w, np.full(len(i), bucket[s]), np.full(len(i), rep[s]))

    return run


def _batch(i, j, w, bucket, rep) -> pa.RecordBatch:
    cols = [pa.array(rep, pa.int32()), pa.array(bucket, pa.int64()), pa.array(np.minimum(i, j), pa.int64()), pa.array(np.maximum(i, j), pa.int64()), pa.array(w, pa.float64())]
    return pa.RecordBatch.from_arrays(cols, names=["rep", "bucket", "i", "j", "w"])


FOUND = "rep int, bucket long, i long, j long, w double"


def bucket_trees(table: DataFrame, points: DataFrame, prefix: int, name: str, new: bool = False, comp: bool = False, tile_rows: int | None = None) -> DataFrame:
    """``rep, bucket, i, j, w``: edges that contain the spanning forest of the pairs of every bucket. With ``comp``,
    pairs whose ``comp`` of ``table`` is the same are left out. Large buckets of points of few dimensions are searched
    whole, without listing pairs: what ``new`` and ``comp`` leave out is then looked at too, and the forest with the tree so far is the same."""
    from graftline.operators.msf import forest

    m = metric(name)
    labels = (("child",) if new else ()) + (("comp",) if comp else ())

    def keep(i, j, w, bucket, rep):
        # buckets of a table share no point, so one forest a table serves all its buckets
        out = [np.flatnonzero(rep == r) for r in np.unique(rep)]
        at = np.concatenate([r[forest(i[r], j[r], w[r])] for r in out])
        return i[at], j[at], w[at], bucket[at], rep[at]

    def whole(ids, x, apart):
        return near.near_tree(ids, x) if near.is_near(x, m) else dense_tree(ids, x, m, apart)

    rows = placed(table, points, prefix, new, tile_rows or (near.ROWS if near.few(points, name) else TILE_ROWS), ("comp",) if comp else ())
    return rows.mapInArrow(_work(m, labels, keep, whole), FOUND)


def bucket_closest(table: DataFrame, points: DataFrame, prefix: int, name: str, k: int, digits: int | None, new: bool = False, tile_rows: int | None = None) -> DataFrame:
    """``i, j, w``: the ``k`` closest pairs by (w, i, j) of those that share a bucket; a pair may come from several tables."""
    m = metric(name)

    def least(i, j, w):
        w = w if digits is None else np.round(w, digits) + 0.0
        a, b = np.minimum(i, j), np.maximum(i, j)
        at = np.lexsort((b, a, w))
        return a[at], b[at], w[at]

    def keep(i, j, w, bucket, rep):
        a, b, w = least(i, j, w)
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        a, b, w = a[first][:k], b[first][:k], w[first][:k]
        return a, b, w, np.zeros(len(a), np.int64), np.zeros(len(a), np.int32)

    def whole(ids, x, apart):
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for r in range(len(ids) - 1):
            rest = np.arange(r + 1, len(ids))
            for label in apart:
                rest = rest[label[rest] != label[r]]
            if len(rest):
                d = m.rows(x[r], x[rest])
                if len(held[2]) >= k:
                    worth = (d if digits is None else np.round(d, digits)) <= held[2][-1]
                    rest, d = rest[worth], d[worth]
                if len(rest):
                    new_ = least(np.full(len(rest), ids[r]), ids[rest], d)
                    both = [np.concatenate(c) for c in zip(held, new_, strict=True)]
                    at = np.lexsort((both[1], both[0], both[2]))[:k]
                    held = tuple(c[at] for c in both)
        return held

    rows = placed(table, points, prefix, new, tile_rows or TILE_ROWS)
    found = rows.mapInArrow(_work(m, ("child",) if new else (), keep, whole), FOUND).select("i", "j", "w")
    # the same pair has the same distance in every table
    return found.distinct().orderBy("w", "i", "j").limit(k)


def chain(table: DataFrame, depth: int) -> DataFrame:
    """``i, j, w``: for neighbours in the order of (rep, code) the symbols missing to a whole common code.

    Points are in one bucket at a prefix exactly if all neighbours between them share it. So the spanning forest of
    these edges tells at which prefix the buckets of all tables connect all points. Partitions chain their own
    rows; their ends, two rows each, are chained in one task.
    """

    def symbols(column: pa.Array) -> np.ndarray:
        return matrix(column).astype(np.int64) if len(column) else np.empty((0, depth), np.int64)

    def link(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, ids, c = t.column("rep").to_numpy(), t.column("vec_id").to_numpy(), symbols(t.column("code"))
        same = np.cumprod(c[1:] == c[:-1], axis=1).sum(axis=1)
        inside = rep[1:] == rep[:-1]
        return np.minimum(ids[1:], ids[:-1])[inside], np.maximum(ids[1:], ids[:-1])[inside], (depth - same[inside]).astype(np.float64)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            first = t.slice(0, 1) if first is None else first
            joined = t if last is None else pa.concat_tables([last, t])
            last = t.slice(t.num_rows - 1)
            i, j, w = link(joined)
            yield pack(i, j, w, None)
        if first is not None:
            ends = pa.concat_tables([first, last])
            none = np.empty(0, np.int64)
            yield pack(none, none, np.empty(0), ends)

    def pack(i, j, w, ends: pa.Table | None) -> pa.RecordBatch:
        n = len(i) if ends is None else ends.num_rows
        rep = pa.nulls(n, pa.int32()) if ends is None else ends.column("rep").combine_chunks().cast(pa.int32())
        code = pa.nulls(n, pa.list_(pa.int64())) if ends is None else pa.concat_arrays(ends.column("code").chunks).cast(pa.list_(pa.int64()))
        if ends is not None:
            i, j, w = ends.column("vec_id").to_numpy(), np.zeros(n, np.int64), np.zeros(n)
        return pa.RecordBatch.from_arrays([rep, code, pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(w, pa.float64())], names=["rep", "code", "i", "j", "w"])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if whole:
            i, j, w = link(pa.concat_tables(whole).combine_chunks())
            keep = i != j
            yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(w[keep])], names=["i", "j", "w"])

    spark = table.sparkSession
    ranged = table.select("rep", "code", "vec_id").repartitionByRange(parallelism(spark), "rep", "code", "vec_id").sortWithinPartitions("rep", "code", "vec_id")
    found = materialize(ranged.mapInArrow(inner, "rep int, code array<long>, i long, j long, w double"), "chain")
    ends = found.filter("rep is not null").select("rep", "code", F.col("i").alias("vec_id")).coalesce(1).sortWithinPartitions("rep", "code", "vec_id")
    return found.filter("rep is null").select("i", "j", "w").unionByName(ends.mapInArrow(outer, "i long, j long, w double"))
