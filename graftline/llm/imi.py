"""Inverted multi-index over dense vectors: two half codebooks, cells, and blocks of neighbouring cells.

Vectors are normalised and both halves quantised on their own, so ``k`` centroids per half give ``k * k``
cells. A row visits the cells nearest to it: centroid pairs in order of their summed distance, taken from a
heap, without the cells whose wall is too far. Cells are grouped into blocks of about ``BLOCK_ROWS`` rows by halving along the direction in which
their centroids spread most, so the cells that a row visits lie in few blocks and its vector travels to few
tasks. A cell too full for a block is cut into shards whose pairs are separate tasks.

The codebooks are fitted on a bounded sample and the number of centroids is bounded, so what the driver and
every task hold doesn't grow with the data.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_CELL = 256
MAX_CENTROIDS = 1024  # of a half; fuller cells are cut into shards
SAMPLE_ROWS = 20_000  # fitted on; at least 50 for each centroid
ROUNDS = 8
BLOCK_ROWS = 65_536
MAX_TASKS = 20_000
_SHARDS = 1 << 13
KINDS = {8: np.int8, 16: np.int16, 32: np.float32}


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and these as rows of stored floats.

    Usable: exactly ``dim`` elements, none null, NaN or infinite, not all zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dim))
    flat = column.values.to_numpy(zero_copy_only=False)  # null elements become NaN
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float32, copy=False)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means on a sample; an empty cluster restarts at a random row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(p @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1) for p in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(count[full])[:-1]], axis=0)
        centres[full] = sums / count[full][:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


@dataclass
class MultiIndex:
    dim: int
    first: np.ndarray  # centroids of the first half
    second: np.ndarray
    count: np.ndarray | None = None  # rows of each cell
    block: np.ndarray | None = None  # block of each cell
    shards: np.ndarray | None = None  # shards of each block

    @property
    def k(self) -> int:
        return len(self.first)

    def tasks(self, least: int) -> int:
        """Partitions for the tasks of all blocks: they grow with the data, so that none holds many blocks."""
        shards = self.shards.astype(np.int64)
        return max(least, min(MAX_TASKS, 3 * int((shards * (shards + 1) // 2).sum())))

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to the centroids, up to a term that is the same for all."""
        half = self.first.shape[1]
        u = u.astype(np.float32)
        parts = ((u[:, :half], self.first), (u[:, half:], self.second))
        return tuple((c**2).sum(1) - 2 * (x @ c.T) for x, c in parts)

    def cells(self, u: np.ndarray) -> np.ndarray:
        a, b = self.distances(u)
        return a.argmin(1).astype(np.int64) * self.k + b.argmin(1)

    @cached_property
    def gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Distances between the centroids of each half."""
        return tuple(np.sqrt(np.maximum(((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T), 1e-12)) for c in (self.first, self.second))

    def visits(self, u: np.ndarray, probes: int, margin: float) -> Iterator[list[int]]:
        """For each row its own cell and then the nearest cells that hold rows, ``probes`` at most.

        A cell is left out if its wall is farther than ``margin``: no vector in it can be nearer to the row.
        """
        near = []
        most = min(self.k, 2 * probes)
        for d, gap in zip(self.distances(u), self.gaps, strict=True):
            own = d.argmin(axis=1)
            rise = d - d.min(axis=1, keepdims=True)
            wall = rise / (2 * gap[own])
            wall[np.arange(len(d)), own] = 0
            rise[wall > margin] = np.inf
            ids = np.argpartition(rise, most - 1, axis=1)[:, :most] if most < self.k else np.tile(np.arange(self.k), (len(d), 1))
            value = np.take_along_axis(rise, ids, 1)
            order = np.argsort(value, axis=1, kind="stable")
            value, ids = np.take_along_axis(value, order, 1), np.take_along_axis(ids, order, 1)
            squares = np.take_along_axis(wall, ids, 1) ** 2
            ids[:, 0], squares[:, 0] = own, 0
            near.append((ids.tolist(), value.tolist(), squares.tolist(), np.isfinite(value).sum(axis=1).tolist()))
        count, k, reach = self.count, self.k, margin**2
        for ia, da, wa, na, ib, db, wb, nb in zip(*near[0], *near[1], strict=True):
            heap, out = [(0.0, 0, 0)], []
            while heap and len(out) < probes:
                _, p, q = heapq.heappop(heap)
                cell = ia[p] * k + ib[q]
                if count[cell] and wa[p] + wb[q] <= reach:
                    out.append(cell)
                if p + 1 < na:
                    heapq.heappush(heap, (da[p + 1] + db[q], p + 1, q))
                if not p and q + 1 < nb:
                    heapq.heappush(heap, (da[0] + db[q + 1], 0, q + 1))
            yield out

    def lay_out(self, count: np.ndarray, block_rows: int = BLOCK_ROWS) -> None:
        """Group the cells into blocks of at most ``block_rows`` rows, or of one cell."""
        self.count, self.block = count, np.full(self.k**2, -1, np.int32)
        axes = [self._axes(self.first), self._axes(self.second)]
        stack, blocks = [np.flatnonzero(count)], []
        while stack:
            cells = stack.pop()
            n = count[cells]
            if len(cells) < 2 or n.sum() <= block_rows:
                self.block[cells] = len(blocks)
                blocks.append(int(n.sum()) if len(cells) else 0)
                continue
            place = np.concatenate([axes[0][cells // self.k], axes[1][cells % self.k]], axis=1)
            mean = (place * n[:, None]).sum(0) / n.sum()
            axis = int((((place - mean) ** 2) * n[:, None]).sum(0).argmax())
            order = np.argsort(place[:, axis], kind="stable")
            cut = int(np.searchsorted(np.cumsum(n[order]), n.sum() / 2)) + 1
            cut = min(max(cut, 1), len(cells) - 1)
            stack += [cells[order[cut:]], cells[order[:cut]]]
        sizes = np.array(blocks or [0])
        self.shards = np.where(sizes > 2 * block_rows, -(-sizes // max(block_rows, -(-int(sizes.max()) // (_SHARDS - 1)))), 1)

    @staticmethod
    def _axes(centres: np.ndarray) -> np.ndarray:
        """Centroids in the four directions in which they spread most."""
        c = centres - centres.mean(0)
        return c @ np.linalg.eigh(c.T @ c)[1][:, -4:]

    def groups(self, block: int, row_id: int, home: bool) -> list[int]:
        """Tasks that a row goes to for a block: one, or a row or the diagonal of the shard pairs."""
        e, base = int(self.shards[block]), block * _SHARDS**2
        if e == 1:
            return [base]
        if not home:
            return [base + t * _SHARDS + t for t in range(e)]
        s = _mix(row_id) % e
        return [base + min(s, t) * _SHARDS + max(s, t) for t in range(e)]


def _mix(x: int) -> int:
    """Spread ids that follow a pattern."""
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return x >> 20


def shard_of(row_ids: np.ndarray, shards: int) -> np.ndarray:
    x = np.asarray(row_ids, np.int64)
    x = (x ^ (x >> 31)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def group_shards(group: int) -> tuple[int, int]:
    """The pair of shards of a task."""
    return group // _SHARDS % _SHARDS, group % _SHARDS


def build(df: DataFrame, row_id: str, vector: str, dim: int, seed: int = 0, block_rows: int = BLOCK_ROWS, most: int = MAX_CENTROIDS) -> MultiIndex | None:
    """Fit the codebooks of at most ``most`` centroids on a sample and count the rows of each cell; None
    without a usable vector."""
    df = df.filter(F.col(row_id).isNotNull())
    total = df.count()
    k = max(1, min(most, math.ceil(math.sqrt(total / ROWS_PER_CELL))))
    share = min(1.0, max(SAMPLE_ROWS, 50 * k) / max(total, 1))
    hashed = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 30))
    sample = df.filter(hashed < int(share * (1 << 30))).select(vector).toArrow() if share < 1 else df.select(vector).toArrow()
    _, x = vectors_of(sample.column(0), dim) if sample.num_rows else (None, np.empty((0, dim), np.float32))
    if not len(x):
        if share == 1:
            return None
        _, x = vectors_of(df.filter(F.size(vector) == dim).limit(SAMPLE_ROWS).select(vector).toArrow().column(0), dim)
        if not len(x):
            x = np.eye(dim, dtype=np.float32)
    u, half = unit(x).astype(np.float32), dim // 2
    rng = np.random.default_rng(seed)
    index = MultiIndex(dim, lloyd(u[:, :half], k, rng), lloyd(u[:, half:], k, rng))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(index.k**2, np.int64)
        for b in batches:
            at, x = vectors_of(b.column(0), dim)
            if len(at):
                count += np.bincount(index.cells(unit(x)), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], names=["cell", "n"])

    found = df.select(vector).mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(index.k**2, np.int64)
    count[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    if not count.any():
        return None
    index.lay_out(count, block_rows)
    return index


def send(df: DataFrame, row_id: str, vector: str, index: MultiIndex, probes: int, margin: float, bits: int = 16) -> DataFrame:
    """Every usable row once for each task it visits: ``grp, row_id, home, cells, vec``.

    ``home`` is the row's own cell in its own block, else -1; ``cells`` are the others it visits there.
    ``vec`` is the direction of the vector in integers of 16 or 8 bits, the largest element at full scale; a
    cosine taken from two of them is off by about 2e-6 or 1e-3. With 32 bits it is the stored vector itself.
    """

    kind = KINDS[bits]
    full = None if bits == 32 else np.iinfo(kind).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                at, x = vectors_of(b.column(1), index.dim)
                if not len(at):
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)[at]
                u = unit(x)
                raw = x if full is None else np.rint(u * (full / np.abs(u).max(axis=1, keepdims=True))).astype(kind)
                src, grp, home, cells = [], [], [], []
                for r, visited in enumerate(index.visits(u, probes, margin)):
                    by: dict[int, list[int]] = {}
                    for c in visited:
                        by.setdefault(int(index.block[c]), []).append(c)
                    for n, (block, inside) in enumerate(by.items()):
                        for g in index.groups(block, int(ids[r]), n == 0):
                            src.append(r)
                            grp.append(g)
                            home.append(visited[0] if n == 0 else -1)
                            cells.append(inside[1:] if n == 0 else inside)
                src_ = np.array(src)
                size = raw.itemsize * index.dim
                data = pa.py_buffer(np.ascontiguousarray(raw[src_]).tobytes())
                vec = pa.Array.from_buffers(pa.binary(), len(src), [None, pa.py_buffer((np.arange(len(src) + 1) * size).astype(np.int32).tobytes()), data])
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(ids[src_], pa.int64()), pa.array(home, pa.int64()), pa.array(cells, pa.list_(pa.int64())), vec], names=["grp", "row_id", "home", "cells", "vec"])

    return df.filter(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long"), vector).mapInArrow(run, "grp long, row_id long, home long, cells array<long>, vec binary")


@dataclass
class Block:
    """The rows of one task, by cell."""

    ids: np.ndarray
    home: np.ndarray
    x: np.ndarray  # directions as integers, or the stored vectors
    pair: tuple[int, int]  # shards of the task; equal unless its cell is cut
    shard: np.ndarray  # of the rows at home, where the cell is cut
    at: dict[int, np.ndarray]  # rows at home in a cell, by row id
    visiting: dict[int, np.ndarray]


def open_block(t: pa.Table, dim: int, shards: np.ndarray, bits: int = 16) -> Block:
    t = t.sort_by("row_id").combine_chunks()
    ids, home = t.column("row_id").to_numpy(), t.column("home").to_numpy()
    vec = t.column("vec").combine_chunks()
    if isinstance(vec, pa.ChunkedArray):
        vec = pa.concat_arrays(vec.chunks)
    offsets = np.frombuffer(vec.buffers()[1], np.int32, len(vec) + 1, vec.offset * 4)
    x = np.frombuffer(vec.buffers()[2], KINDS[bits], len(vec) * dim, int(offsets[0])).reshape(-1, dim)
    group = int(t.column("grp")[0].as_py())
    pair = group_shards(group)
    cells = t.column("cells").combine_chunks()
    if isinstance(cells, pa.ChunkedArray):
        cells = pa.concat_arrays(cells.chunks)
    bounds = cells.offsets.to_numpy()
    flat, owner = cells.values.to_numpy()[bounds[0] : bounds[-1]], np.repeat(np.arange(len(ids)), np.diff(bounds))
    at_home = np.flatnonzero(home >= 0)

    def by_cell(cell: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
        if not len(cell):
            return {}
        order = np.argsort(cell, kind="stable")
        keys, starts = np.unique(cell[order], return_index=True)
        return {int(c): part for c, part in zip(keys, np.split(rows[order], starts[1:]), strict=True)}

    cut = int(shards[group // _SHARDS**2])
    shard = shard_of(ids, cut) if cut > 1 else np.zeros(len(ids), np.int64)
    return Block(ids, home, x, pair, shard, by_cell(home[at_home], at_home), by_cell(flat, owner))


def only(df: DataFrame, row_id: str, vector: str, wanted: DataFrame, dim: int, most_bits: int = 1 << 27) -> DataFrame:
    """``row, vec`` of the rows of ``df`` that may be among ``wanted(row)``, to shrink a join on them.

    The wanted ids set bits of a bitmap by their hash. It has eight bits for each row of ``df`` up to
    ``most_bits`` (16 MB), so it may be sent to all tasks; where it is too small more rows pass, none is lost.
    """
    bits = min(most_bits, max(1 << 15, 1 << (8 * df.count()).bit_length()))
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    parts = wanted.select((place + 1).alias("b"))  # bits of bitmap functions count from 1
    parts = parts.groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).toArrow()
    bitmap = np.zeros(bits // 8 + 8192, np.uint8)
    for n, m in zip(parts.column("n").to_pylist(), parts.column("m").to_pylist(), strict=True):
        bitmap[(n - 1) * 4096 : n * 4096] = np.frombuffer(m, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield b.filter(pa.array(hit.astype(bool))).select(["row", "vec"])

    rows = df.filter(F.size(vector) == dim).select(F.col(row_id).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("vec")).filter("row is not null")
    return rows.withColumn("b", place).mapInArrow(run, "row long, vec array<float>")
