"""Similarity joins of token sets in tiles: every pair of sets is met, compared and told in one task, so no pair travels.

Sets go by their id to blocks and every two blocks to a task, each token as the number that its MinHash starts from. Within a task rows
of a common key are sorted by size, so that only pairs of fitting sizes are listed; bitmaps of the tokens end most that differ too much and
the tokens themselves decide. Equal numbers are equal tokens, as ``distinct_numbers`` looks for tokens that share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.families import PRIME, minhash_factors, token_number
from graftline.operators.msf import EDGE

BLOCK_ROWS = 98_304
LEAST_BLOCKS = 3  # of sets that aren't few, so that there are tasks enough
FEW = 2048
LIST = 1_000_000  # pairs listed at once
HELD = 3_000_000  # pairs met, until those met again are dropped
TOKENS = 2_000_000  # compared at once
WORDS = 8  # of a bitmap, 64 bits each


def distinct_numbers(reps: DataFrame) -> bool:
    """Whether no two tokens of the sets have the same number."""
    tokens = reps.select(F.explode("tokens").alias("t")).distinct()
    return tokens.groupBy(token_number(F.col("t")).alias("number")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()


class Sets:
    """Rows of one task; of every set the tokens as positions in ``numbers``, the rarest first."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]]
        at, numbers = pd.factorize(flat)
        order = np.argsort(np.bincount(at, minlength=len(numbers)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.numbers = numbers[order]
        key = (np.repeat(np.arange(len(ids)), sizes) << 32) | place[at]
        key.sort()
        self.tokens = (key & 0xFFFFFFFF).astype(np.int32)
        word, bit = self.numbers % WORDS, np.uint64(1) << (self.numbers // WORDS % 64).astype(np.uint64)
        self.bits = np.empty((len(ids), WORDS), np.uint64)
        for k in range(WORDS):
            self.bits[:, k] = np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0))[self.tokens], self.starts)

    def unlike(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the bitmaps of rows differ in more bits than sets so similar can in tokens."""
        most = (self.sizes[a] + self.sizes[b]) * ((1 - threshold) / (1 + threshold)) + 1e-6
        out = np.bitwise_count(self.bits[a, 0] ^ self.bits[b, 0]).astype(np.int64)
        for k in range(1, 3):
            out += np.bitwise_count(self.bits[a, k] ^ self.bits[b, k])
        rest = np.flatnonzero(out <= most)
        out[rest] += np.bitwise_count(self.bits[a[rest], 3:] ^ self.bits[b[rest], 3:]).sum(axis=1, dtype=np.int64)
        return out > most

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of common tokens of rows."""

        def keys(rows: np.ndarray) -> np.ndarray:
            n = self.sizes[rows]
            pair = np.repeat(np.arange(len(rows)), n)
            return (pair << 32) | self.tokens[np.arange(len(pair)) + np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)]

        both = np.concatenate([keys(a), keys(b)])
        both.sort(kind="stable")  # two runs in order
        return np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(a))


def prefix_keys(sets: Sets, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``key, row, early``: the tokens to meet by. Of a pair so similar the larger set has a common one among its first, the smaller among its early ones."""
    n = sets.sizes
    first = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
    fewer = n - np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9).astype(np.int64) + 1
    row = np.repeat(np.arange(len(n)), first)
    place = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first)
    yield sets.tokens[sets.starts[row] + place].astype(np.int64), row, place < fewer[row]


def bucket_keys(sets: Sets, repetitions: int, depth: int, seed: int, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``key, row, early`` of the MinHash buckets at ``prefix``, table by table."""
    rows, factors = np.arange(len(sets.ids)), minhash_factors(repetitions, depth, seed)
    x = sets.numbers % PRIME
    for rep in range(repetitions):
        key = np.zeros(len(rows), np.int64)
        for scale, shift in factors[rep * depth : rep * depth + prefix]:
            symbol = np.minimum.reduceat(((scale * x + shift) % PRIME)[sets.tokens], sets.starts)
            key = pd.factorize(key << 32 | pd.factorize(symbol)[0])[0].astype(np.int64)
        yield key, rows, np.ones(len(rows), bool)


def _met(sets: Sets, side: np.ndarray, across: bool, keys: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Pairs of rows that share a key and may be so similar, each once, as ``larger << 32 | smaller``."""
    held, new, n = np.empty(0, np.int64), [], sets.sizes
    wide = int(n.max()) + 1

    def fold() -> np.ndarray:
        return np.unique(np.concatenate([held, *new]))

    for key, row, early in keys:
        for x_side in (0, 1) if across else (0,):
            x = side[row] == x_side
            y = early & (side[row] == (1 - x_side if across else 0))
            xk, xr, yk, yr = key[x], row[x], key[y], row[y]
            order = np.argsort(yk * wide + n[yr])
            yr, by = yr[order], (yk * wide + n[yr])[order]
            least = np.maximum(np.ceil(n[xr] * threshold - 1e-9).astype(np.int64), 1)
            low, high = np.searchsorted(by, xk * wide + least), np.searchsorted(by, xk * wide + n[xr], side="right" if x_side == 0 else "left")
            some = np.flatnonzero(high > low)
            xr, low, count = xr[some], low[some], (high - low)[some]
            ends = np.cumsum(count)
            cuts = np.unique(np.searchsorted(ends, np.arange(LIST, int(ends[-1]) if len(ends) else 0, LIST)))
            for part in np.split(np.arange(len(xr)), cuts):
                c = count[part]
                a = np.repeat(xr[part], c)
                b = yr[np.arange(len(a)) + np.repeat(low[part] - (np.cumsum(c) - c), c)]
                if not across:
                    fit = (n[b] < n[a]) | (b < a)
                    a, b = a[fit], b[fit]
                fit = ~sets.unlike(a, b, threshold)
                new.append(a[fit] << 32 | b[fit])
                if sum(map(len, new)) > HELD:
                    held = fold()
                    new.clear()
    return fold()


def joined(reps: DataFrame, threshold: float, keys: Callable[[Sets], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``i, j, w``: pairs i < j of sets that share one of ``keys`` and have a Jaccard similarity of at least ``threshold``; w is the distance."""
    n = reps.count()
    blocks = max(LEAST_BLOCKS if n > FEW else 1, -(-n // block_rows))
    sent = reps.select(F.col("id").cast("long").alias("id"), F.transform("tokens", token_number).alias("numbers"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tile = ((high * (high + 1)) / 2).cast("int") + low
    sent = sent.select(tile.alias("tile"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") != F.col("other")).alias("across"), "id", "numbers")

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        numbers = t.column("numbers").chunk(0)
        sets = Sets(t.column("id").to_numpy(), np.diff(numbers.offsets.to_numpy()).astype(np.int64), numbers.flatten().to_numpy())
        side, across = t.column("side").to_numpy(), t.column("across")[0].as_py()
        del t, numbers
        met = _met(sets, side, across, keys(sets), threshold)
        a, b = met >> 32, met & 0xFFFFFFFF
        ends = np.cumsum(sets.sizes[a] + sets.sizes[b])
        cuts = np.unique(np.searchsorted(ends, np.arange(TOKENS, int(ends[-1]) if len(ends) else 0, TOKENS)))
        for p, q in zip(np.split(a, cuts), np.split(b, cuts), strict=True):
            if not len(p):
                continue
            same = sets.shared(p, q)
            union = sets.sizes[p] + sets.sizes[q] - same
            good = same >= threshold * union - 1e-9
            i, j, w = sets.ids[p[good]], sets.ids[q[good]], 1.0 - same[good] / union[good]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(w)], names=["i", "j", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            t = pa.Table.from_batches(whole)
            del whole
            tiles = t.column("tile").to_numpy()
            if (tiles == tiles[0]).all():
                yield from one(t)
            else:
                for k in np.unique(tiles):
                    yield from one(t.filter(pa.array(tiles == k)))

    return sent.repartitionById(blocks * (blocks + 1) // 2, F.col("tile")).mapInArrow(run, EDGE)
