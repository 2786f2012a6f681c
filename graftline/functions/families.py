"""Seeded hash families: projections, codes and collision probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions import probability


@dataclass(frozen=True)
class Family:
    """``repetitions`` tables of ``depth`` symbols for vectors of ``dim`` elements.

    The projections are drawn once from the seed, in the order (repetition, symbol), so codes are the same in
    every run. A family is small: what travels to the tasks is ``repetitions * depth * dim`` numbers.
    """

    dim: int
    repetitions: int
    depth: int
    seed: int = 42

    def __post_init__(self):
        if min(self.dim, self.repetitions, self.depth) < 1:
            raise ValueError("dimension, repetitions and depth must be at least 1")

    @cached_property
    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.repetitions, self.depth, self.dim))

    def symbols(self, x: np.ndarray) -> np.ndarray:
        """Codes of rows, shaped (rows, repetitions, depth)."""
        raise NotImplementedError

    def collision(self, distance: Column) -> Column:
        raise NotImplementedError

    def failure(self, distance: Column, prefix: Column | int, seen: Column | int | None = None) -> Column:
        return probability.failure(self.collision(distance), prefix, self.repetitions if seen is None else seen, self.repetitions, self.depth)

    def describe(self) -> str:
        return f"{type(self).__name__}(dim={self.dim}, repetitions={self.repetitions}, depth={self.depth}, seed={self.seed})"


@dataclass(frozen=True)
class SimHash(Family):
    """Signs of random projections; for cosine distances."""

    metric = "cosine"

    def symbols(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,lkd->nlk", x, self.planes, optimize=True) >= 0).astype(np.int64)

    def collision(self, distance: Column) -> Column:
        return probability.simhash_collision(distance)


@dataclass(frozen=True)
class E2LSH(Family):
    """Buckets of random projections; for Euclidean distances."""

    width: float = 2.0
    metric = "euclidean"

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).uniform(0, self.width, (self.repetitions, self.depth))

    def symbols(self, x: np.ndarray) -> np.ndarray:
        return np.floor((np.einsum("nd,lkd->nlk", x, self.planes, optimize=True) + self.offsets) / self.width).astype(np.int64)

    def collision(self, distance: Column) -> Column:
        return probability.e2lsh_collision(distance, self.width)


@dataclass(frozen=True)
class CrossPolytope(Family):
    """Nearest signed axis after a random rotation of ``axes`` dimensions; for angles. ``weights`` says whether
    distances are cosine or angular.

    A symbol is 2 * axis, plus 1 if the coordinate is negative; ties go to the lower axis. The collision
    probability has no closed form and is estimated by a seeded simulation.
    """

    axes: int = 8
    weights: str = "cosine"

    def __post_init__(self):
        super().__post_init__()
        if self.weights not in ("cosine", "angular"):
            raise ValueError("weights must be cosine or angular")

    @property
    def metric(self) -> str:
        return self.weights

    @cached_property
    def rotations(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.repetitions, self.depth, self.axes, self.dim))

    def symbols(self, x: np.ndarray) -> np.ndarray:
        y = np.einsum("nd,lkad->nlka", x, self.rotations, optimize=True)
        best = np.abs(y).argmax(axis=-1)
        return (2 * best + (np.take_along_axis(y, best[..., None], -1)[..., 0] < 0)).astype(np.int64)

    @cached_property
    def curve(self) -> list[tuple[float, float]]:
        rng, out = np.random.default_rng(self.seed + 2), []
        a = rng.standard_normal((20_000, self.axes))
        b = rng.standard_normal((20_000, self.axes))

        def symbol(y: np.ndarray) -> np.ndarray:
            best = np.abs(y).argmax(axis=1)
            return 2 * best + (y[np.arange(len(y)), best] < 0)

        for cos in np.linspace(1, -1, 41):
            out.append((float(1 - cos), float((symbol(a) == symbol(cos * a + np.sqrt(max(0.0, 1 - cos * cos)) * b)).mean())))
        return out

    def collision(self, distance: Column) -> Column:
        if self.weights == "angular":
            distance = F.lit(1.0) - F.cos(distance)
        out = F.lit(self.curve[-1][1])
        for (d0, p0), (d1, p1) in reversed(list(zip(self.curve, self.curve[1:], strict=False))):
            out = F.when(distance <= d1, F.lit(p0) + (distance - F.lit(d0)) * F.lit((p1 - p0) / (d1 - d0))).otherwise(out)
        return out


def codes(points: DataFrame, family: Family, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, rep, code``: a row per point and table; vectors of another length or null are an error."""
    reps, dim = family.repetitions, family.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column(1)
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != dim).any():
                raise ValueError(f"every vector must have {dim} elements")
            s = vectors.offsets[0].as_py()
            x = vectors.values.to_numpy(zero_copy_only=False)[s : s + len(vectors) * dim].reshape(-1, dim).astype(np.float64)
            c = family.symbols(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) * reps + 1, dtype=np.int32) * family.depth), pa.array(c.ravel()))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), reps)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(reps, dtype=np.int32), len(x))), flat], names=["vec_id", "rep", "code"])

    return points.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "vec_id long, rep int, code array<long>")


PRIME = (1 << 31) - 1


def minhash_factors(repetitions: int, depth: int, seed: int) -> list[tuple[int, int]]:
    """``a`` and ``b`` of the hashes ``(a * x + b) mod PRIME`` of all symbols."""
    drawn = np.random.default_rng(seed).integers(1, PRIME, (repetitions * depth, 2))
    return [(int(a), int(b)) for a, b in drawn]


def token_number(token: Column) -> Column:
    """The first 15 hex digits of the token's md5 as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long")


def minhash_codes(sets: DataFrame, repetitions: int, depth: int, seed: int = 42, set_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``<set_id>, rep, code`` for sets of strings: a symbol is the least seeded hash of the set's tokens.

    A token is hashed once, to the first 15 hex digits of its md5 modulo ``PRIME``, the same in any engine; the hashes
    of the symbols are linear in that. Empty sets have no code.
    """
    number = F.transform(tokens, lambda t: token_number(t) % F.lit(PRIME))
    factors = minhash_factors(repetitions, depth, seed)
    some = sets.filter(F.size(tokens) > 0).select(set_id, number.alias("numbers"))
    schema = T.StructType([some.schema[set_id], T.StructField("rep", T.IntegerType()), T.StructField("code", T.ArrayType(T.LongType()))])
    scale, shift = (np.array(f, np.int64)[:, None] for f in zip(*factors, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            bounds = lists.offsets.to_numpy()
            x = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
            least = np.empty((len(factors), b.num_rows), np.int64)
            starts = bounds[:-1] - bounds[0]
            step = max(1, 4_000_000 // max(1, len(x)))
            for s in range(0, len(factors), step):
                least[s : s + step] = np.minimum.reduceat((scale[s : s + step] * x + shift[s : s + step]) % PRIME, starts, axis=1)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), repetitions)))
            code = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows * repetitions + 1, dtype=np.int32) * depth), pa.array(least.T.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(repetitions, dtype=np.int32), b.num_rows)), code], names=[set_id, "rep", "code"])

    return some.mapInArrow(run, schema)
