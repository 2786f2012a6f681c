"""Most similar vectors for every vector, by an inverted multi-index.

Each row visits its nearest cells (``imi``). In a task, the rows that visit a cell are compared with the rows
at home there in one matrix product per cell; both sides keep their best, so a pair is found if either row
visits the other's cell. The entries are 16-bit directions, so their cosines have an error; each task passes on
all that may be among a row's best within that error. A window merges what the tasks found and settles what
the error leaves no doubt about; the rest, few rows, is reranked by the cosine of the stored vectors.

The exact way has one cell, cut into shards: every pair of shards is a task, so all vectors are compared and
nothing is missed at any distance. Its work grows with the square of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm import imi
from graftline.session import materialize, parallelism

PROBES = 16
MARGIN = 0.07  # a search within a small radius needs no cell whose wall is farther
SMALL_RADIUS = 0.3
SHARE = 0.2  # of the cells, visited by a search at any distance
PRODUCT = 4_000_000  # elements of a matrix product at a time
LOOSE = 4e-6  # error of a single-precision cosine, twice
TILE = 2048  # rows of either side of a product of the exact way
SHARD_ROWS = 50_000  # of the exact way
ERROR = 3e-6  # of the distance of two 16-bit directions, at most
STEP = 1e-8  # distances are compared in whole steps


def copies(x: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep so that of equal vectors only the first ``most`` stay."""
    view = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group, count = np.unique(view, return_inverse=True, return_counts=True)
    if count.max() <= most:
        return np.ones(len(x), bool)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    return place < most


class Best:
    """The ``k`` most similar entries of every row of a task, as they are offered, with all that equal the last within the
    error. An entry may be offered again. ``least`` is the similarity that is asked at least."""

    def __init__(self, x: np.ndarray, entry: np.ndarray, k: int, least: float):
        self.x, self.entry, self.k, self.least = x, entry, k, np.float32(least)
        self.best = np.full((len(x), k), least, np.float32)  # of every row so far, largest first
        self.who = np.full((len(x), k), -1)  # and the entries these are of
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, rows: np.ndarray, others: np.ndarray) -> None:
        """Entries among ``others`` for ``rows``; both are sorted, and a row isn't offered itself."""
        others = others[self.entry[others]]
        step = max(1, PRODUCT // max(1, len(others)))
        for s in range(0, len(rows) if len(others) else 0, step):
            self._offer(rows[s : s + step], others)

    def _offer(self, rows: np.ndarray, others: np.ndarray) -> None:
        k, best = self.k, self.best
        sims = self.x[rows] @ self.x[others].T
        at = np.searchsorted(others, rows)
        own = np.flatnonzero((at < len(others)) & (others[np.minimum(at, len(others) - 1)] == rows))
        sims[own, at[own]] = -9
        last = best[rows, -1]
        floor = last - np.float32(LOOSE)
        fresh = np.flatnonzero(last <= self.least)
        if len(fresh) and len(others) > k:
            fresh = fresh[(sims[fresh] >= self.least).any(axis=1)]
            most = np.partition(sims[fresh], len(others) - k, axis=1)[:, len(others) - k]
            floor[fresh] = np.maximum(floor[fresh], most - np.float32(LOOSE))
        r, c = np.divmod(np.flatnonzero(sims >= floor[:, None]), len(others))
        new = (self.who[rows[r]] != others[c][:, None]).all(axis=1)
        r, c = r[new], c[new]
        if not len(r):
            return
        value = sims[r, c]
        self.found.append((rows[r], others[c], value))
        some, r = np.unique(r, return_inverse=True)
        both = np.concatenate([np.repeat(np.arange(len(some)), k), r])
        value = np.concatenate([best[rows[some]].ravel(), value])
        who = np.concatenate([self.who[rows[some]].ravel(), others[c]])
        order = np.lexsort((-value, both))
        count = np.bincount(both)
        first = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
        best[rows[some]], self.who[rows[some]] = value[first], who[first]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """``row, other``."""
        if not self.found:
            none = np.empty(0, np.int64)
            return none, none
        r, c, value = (np.concatenate(f) for f in zip(*self.found, strict=True))
        keep = value >= self.best[r, -1] - np.float32(LOOSE)
        return r[keep], c[keep]


def search_block(b: imi.Block, k: int, radius: float, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, other, distance``: the best of every row of a task among the cells it visits there."""
    x = b.x.astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    # of a vector's copies any row needs at most k, and one more if it is itself among them
    best = Best(x, copies(b.x, k + 1), k, 1 - radius - LOOSE)
    low, high = b.pair
    for cell, rows in b.at.items():
        mine, theirs = (rows[b.shard[rows] == low], rows[b.shard[rows] == high]) if low != high else (rows, rows)
        if exact:
            tiles = [[side[s : s + TILE] for s in range(0, len(side), TILE)] for side in (mine, theirs)]
            for n, p in enumerate(tiles[0]):
                for m, q in enumerate(tiles[1]):
                    if low != high or m >= n:
                        best.offer(p, q)
                        if low != high or m > n:
                            best.offer(q, p)
            continue
        best.offer(mine, theirs)
        if low != high:
            best.offer(theirs, mine)
        elif cell in b.visiting:
            best.offer(b.visiting[cell], rows)
            best.offer(rows, b.visiting[cell])
    found = [best.result()]
    if not sum(len(r) for r, _ in found):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    r, c = (np.concatenate(p) for p in zip(*found, strict=True))
    distance = np.empty(len(r))
    stored = b.x.dtype == np.float32
    u = imi.unit(b.x) if stored else None
    norm = None if stored else np.sqrt(np.einsum("ij,ij->i", b.x.astype(np.float64), b.x.astype(np.float64)))
    for s in range(0, len(r), 50_000):
        p, q = r[s : s + 50_000], c[s : s + 50_000]
        if stored:
            distance[s : s + 50_000] = 1 - np.einsum("ij,ij->i", u[p], u[q])
        else:
            distance[s : s + 50_000] = 1 - np.einsum("ij,ij->i", b.x[p].astype(np.float64), b.x[q].astype(np.float64)) / (norm[p] * norm[q])
    distance = np.round(distance, 9) + 0.0
    order = np.lexsort((b.ids[c], distance, r))
    r, c, distance = r[order], c[order], distance[order]
    fresh = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])]
    r, c, distance = r[fresh], c[fresh], distance[fresh]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    size = np.diff(np.r_[starts, len(r)])
    slack = 0.0 if stored else 2 * ERROR
    last = np.repeat(distance[np.minimum(starts + k, starts + size) - 1], size)
    good = (distance <= last + slack) & (distance <= radius + slack)
    if stored:
        good &= np.arange(len(r)) - np.repeat(starts, size) < k
    return b.ids[r[good]], b.ids[c[good]], distance[good]


def settled(found: DataFrame, df: DataFrame, row_id: str, vector: str, dim: int, k: int, radius: float) -> DataFrame:
    """``row, other`` of the ``k`` nearest, from distances with an error of ``ERROR``.

    A candidate with at most ``k`` candidates that may be as near or nearer is among the nearest, one with ``k``
    surely nearer isn't. The others of these rows are decided by the stored vectors, which are joined to them alone.
    """
    slack = int(2 * ERROR / STEP) + 1
    order = Window.partitionBy("row").orderBy("d")
    once = found.repartition("row").groupBy("row", "other").agg(F.min("distance").alias("distance")).withColumn("d", F.round(F.col("distance") / STEP).cast("long"))
    ranked = once.withColumn("may", F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, slack))).withColumn("sure", F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, -slack - 1)))
    inside = (F.col("may") <= k) & (F.col("distance") <= radius - ERROR)
    outside = (F.col("sure") >= k) | (F.col("distance") > radius + ERROR)
    state = ranked.filter(~outside).select("row", "other", inside.alias("inside"))
    state = materialize(state.withColumn("taken", F.sum(F.col("inside").cast("int")).over(Window.partitionBy("row"))), "settled")
    doubt = state.filter("not inside")
    certain = state.filter("inside").select("row", "other")
    if doubt.isEmpty():
        return certain
    ends = materialize(doubt.select(F.explode(F.array("row", "other")).alias("row")).distinct(), "doubtful")
    vectors = materialize(imi.only(df, row_id, vector, ends, dim).join(ends, "row", "left_semi").dropDuplicates(["row"]), "stored")
    a = vectors.select("row", F.col("vec").alias("x"))
    b = vectors.select(F.col("row").alias("other"), F.col("vec").alias("y"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            u, v = (imi.unit(imi.vectors_of(t.column(c), dim)[1]) for c in (3, 4))
            distance = np.round(1 - np.einsum("ij,ij->i", u, v), 9) + 0.0
            yield pa.RecordBatch.from_arrays([*t.columns[:3], pa.array(distance)], names=["row", "other", "taken", "distance"])

    both = doubt.join(a, "row").join(b, "other").select("row", "other", "taken", "x", "y")
    again = both.mapInArrow(exact, "row long, other long, taken long, distance double")
    best = Window.partitionBy("row").orderBy("distance", "other")
    # a row in doubt about the radius only still holds its place, so the radius comes after the rank
    chosen = again.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") + F.col("taken") <= k) & (F.col("distance") <= radius))
    return certain.unionByName(chosen.select("row", "other"))


def _search(df: DataFrame, row_id: str, vector: str, dim: int, k: int, radius: float, probes: int | None, margin: float | None, seed: int, block_rows: int | None, exact: bool, bits: int) -> DataFrame | None:
    rows = block_rows or (SHARD_ROWS if exact else imi.BLOCK_ROWS)
    index = imi.build(df, row_id, vector, dim, seed, rows, 1 if exact else imi.MAX_CENTROIDS)
    if index is None:
        return None
    near = radius <= SMALL_RADIUS
    probes = probes or (PROBES if near else max(PROBES, math.ceil(SHARE * np.count_nonzero(index.count))))
    margin = margin if margin is not None else MARGIN if near else math.inf

    def search(key, t):
        found = search_block(imi.open_block(t, dim, index.shards, bits), k, radius, exact)
        return pa.table([pa.array(c) for c in found], names=["row", "other", "distance"])

    sent = imi.send(df, row_id, vector, index, probes, margin, bits).repartition(index.tasks(parallelism(df.sparkSession)), "grp")
    return sent.groupBy("grp").applyInArrow(search, "row long, other long, distance double").filter("row <> other")


def nearest(df: DataFrame, row_id: str, vector: str, dim: int, k: int, radius: float = 2.0, probes: int | None = None, margin: float | None = None, seed: int = 0, block_rows: int | None = None, exact: bool = False) -> DataFrame:
    """``row, other, distance, rank``: the ``k`` most similar other vectors of each row within cosine
    distance ``radius``, in order of distance and id.

    Vectors of another length than ``dim``, with null, NaN or infinite elements or of zeros only are
    left out, as are null ids; other columns are ignored; an empty table gives no rows. Ids must be whole
    numbers; a row repeated under its id counts once. Copies of a vector are neighbours at distance 0. Results
    are approximate: a pair is missed if neither row visits the other's cell; more ``probes`` and a wider
    ``margin`` find more. By default a search within ``SMALL_RADIUS`` visits ``PROBES`` cells with walls up to
    ``MARGIN``, and one at any distance a ``SHARE`` of all cells. ``exact`` compares all pairs instead. Distances are those of the stored vectors in double
    precision, rounded to nine decimals.
    """
    found = _search(df, row_id, vector, dim, k, radius, probes, margin, seed, block_rows, exact, 32)
    if found is None:
        return df.sparkSession.createDataFrame([], "row long, other long, distance double, rank int")
    # a pair found twice has the same distance, so it takes one place
    order = Window.partitionBy("row").orderBy("distance", "other")
    return found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).distinct()


def nearest_pairs(df: DataFrame, row_id: str, vector: str, dim: int, k: int, radius: float = 2.0, probes: int | None = None, margin: float | None = None, seed: int = 0, block_rows: int | None = None) -> DataFrame:
    """``row, other`` of ``nearest``, from vectors of half the size and with a rerank of those in doubt only."""
    found = _search(df, row_id, vector, dim, k, radius, probes, margin, seed, block_rows, False, 16)
    if found is None:
        return df.sparkSession.createDataFrame([], "row long, other long")
    return settled(found, df, row_id, vector, dim, k, radius)
