"""Percentiles with multiplicative rank error: mergeable relative-rank compactors.

A sketch is a tower of compactors; an item in level h stands for 2^h values. A full compactor sorts its
buffer, keeps the half at the protected tail untouched, and of the other half compacts as many sections as
its schedule says, those next to the protected half least often: every second item moves one level up, the
others are dropped. So values at the protected tail are kept nearly all, and the rank error is in proportion
to the distance from that tail. Sketches merge level by level, in any order.

A compaction in level h moves the estimated rank of a value by at most 2^h, up or down by a coin of its own. So a
sketch that counts its compactions knows how far off its ranks can be, but with a given small chance (``slack``).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = 32  # values of a section at first; the rank error falls with it
SECTIONS = 3
LEAST_SECTION = 4
HELD = 2_000_000  # values that a task holds in sketches before it passes them on
CHUNK = 500_000  # rows that a task sorts at once
FAN_IN = 64


class RelativeSketch:
    """Sketch of a multiset of numbers; ``high`` protects the large values, else the small ones."""

    def __init__(self, high: bool = True, section: int = SECTION, seed: int = 0):
        self.high, self.section, self.n = high, section, 0
        self.low_value, self.high_value = math.inf, -math.inf
        self.seed, self.rng = seed, None
        self.buffers: list[np.ndarray] = []
        self.shape: list[list[int]] = []  # per level: schedule state, sections, values of a section, compactions
        self._grow()

    def _grow(self) -> None:
        self.buffers.append(np.empty(0))
        self.shape.append([0, SECTIONS, self.section, 0])

    @staticmethod
    def _room(shape: list[int]) -> int:
        return 2 * shape[1] * shape[2]

    def held(self) -> int:
        return sum(map(len, self.buffers))

    def update(self, values: np.ndarray) -> None:
        """Add numbers; NaN isn't allowed."""
        if not len(values):
            return
        self.n += len(values)
        self.low_value, self.high_value = min(self.low_value, float(values.min())), max(self.high_value, float(values.max()))
        at = 0
        while at < len(values):
            take = max(1, self._room(self.shape[0]) - len(self.buffers[0]))
            self.buffers[0] = np.concatenate([self.buffers[0], values[at : at + take]])
            at += take
            self._compress()

    def merge(self, other: RelativeSketch) -> None:
        if (self.high, self.section) != (other.high, other.section):
            raise ValueError("only sketches of one kind merge")
        self.n += other.n
        self.low_value, self.high_value = min(self.low_value, other.low_value), max(self.high_value, other.high_value)
        while len(self.buffers) < len(other.buffers):
            self._grow()
        for h, buffer in enumerate(other.buffers):
            mine, theirs = self.shape[h], other.shape[h]
            mine[0] |= theirs[0]
            mine[3] += theirs[3]
            if theirs[1] > mine[1]:
                mine[1:3] = theirs[1:3]
            self.buffers[h] = np.concatenate([self.buffers[h], buffer])
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.buffers):
            while len(self.buffers[h]) >= self._room(self.shape[h]):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        if h + 1 == len(self.buffers):
            self._grow()
        shape, values = self.shape[h], np.sort(self.buffers[h])
        state, sections, size, _ = shape
        trailing = (~state & (state + 1)).bit_length() - 1  # ones at the end of the state
        free = min(sections, trailing + 1) * size + len(values) - self._room(shape)
        free -= free % 2
        part, rest = (values[:free], values[free:]) if self.high else (values[len(values) - free :], values[: len(values) - free])
        if self.rng is None:
            self.rng = np.random.default_rng(self.seed)
        self.buffers[h] = rest
        self.buffers[h + 1] = np.concatenate([self.buffers[h + 1], part[int(self.rng.integers(2)) :: 2]])
        shape[0] += 1
        shape[3] += 1
        smaller = 2 * round(size / math.sqrt(2) / 2)
        if shape[0] >= 1 << (sections - 1) and smaller >= LEAST_SECTION:
            shape[1], shape[2] = 2 * sections, smaller

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.buffers)
        order = np.argsort(values, kind="stable")
        return values[order], np.concatenate([np.full(len(b), 1 << h, np.int64) for h, b in enumerate(self.buffers)])[order]

    def rank(self, value: float, inclusive: bool = True) -> int:
        """Estimated number of values up to ``value``, or below it."""
        return int(sum((np.count_nonzero(b <= value) if inclusive else np.count_nonzero(b < value)) << h for h, b in enumerate(self.buffers)))

    def quantile(self, q: float) -> float | None:
        """The smallest kept value that at least a share ``q`` doesn't exceed; None without values."""
        if not self.n:
            return None
        values, weight = self._weighted()
        at = int(np.searchsorted(np.cumsum(weight), math.ceil(q * self.n - 1e-9)))
        return float(values[min(at, len(values) - 1)]) + 0.0

    def slack(self, miss: float = 1e-9) -> float:
        """Most that a rank is off, but with a chance of ``miss``: Hoeffding's bound over all compactions, each off by
        2^h either way. It holds for any value and is wide near the protected tail."""
        return math.sqrt(2 * math.log(2 / miss) * sum(s[3] << 2 * h for h, s in enumerate(self.shape)))

    @property
    def exact(self) -> bool:
        return len(self.buffers) == 1

    def to_bytes(self) -> bytes:
        head = struct.pack("<?iqddi", self.high, self.section, self.n, self.low_value, self.high_value, len(self.buffers))
        levels = [struct.pack("<qiiqi", *s, len(b)) + b.astype("<f8").tobytes() for s, b in zip(self.shape, self.buffers, strict=True)]
        return head + b"".join(levels)

    @classmethod
    def from_bytes(cls, raw: bytes, seed: int = 0) -> RelativeSketch:
        high, section, n, low, top, levels = struct.unpack_from("<?iqddi", raw)
        at = struct.calcsize("<?iqddi")
        out = cls(high, section, seed)
        out.n, out.low_value, out.high_value, out.buffers, out.shape = n, low, top, [], []
        for _ in range(levels):
            *shape, length = struct.unpack_from("<qiiqi", raw, at)
            at += struct.calcsize("<qiiqi")
            out.shape.append(shape)
            out.buffers.append(np.frombuffer(raw, "<f8", length, at).copy())
            at += 8 * length
        return out


def _sketch(n_keys: int, names: list[str], high: bool, section: int):
    """Arrow map-side sketching: rows are sorted by key in large chunks, each key of the partition gets a
    sketch, and all are passed on early when they hold much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, RelativeSketch] = {}
        chunk: list[pa.RecordBatch] = []
        size = rows = 0

        def add() -> int:
            grown = 0
            t = pa.Table.from_batches(chunk).combine_chunks()
            t = t.sort_by([(c, "ascending") for c in names[:n_keys]]).combine_chunks()
            values = t.column(n_keys).to_numpy() + 0.0
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in t.columns[:n_keys]:
                codes = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            first = t.select(list(range(n_keys))).take(pa.array(starts))
            keys = zip(*(c.to_pylist() for c in first.columns), strict=True)
            for key, lo, hi in zip(keys, starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
                s = held.get(key)
                if s is None:
                    s = held[key] = RelativeSketch(high, section, seed=part * 1_000_003 + len(held))
                    grown += 16
                before = s.held()
                s.update(values[lo:hi])
                grown += s.held() - before
            return grown

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(k), t) for k, t in zip(zip(*held, strict=True), types, strict=True)]
            sketches = pa.array([s.to_bytes() for s in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, sketches], names=[*names[:n_keys], "sketch"])

        types: list[pa.DataType] = []
        for b in batches:
            if not b.num_rows:
                continue
            types = [c.type for c in b.columns[:n_keys]]
            chunk.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                size += add()
                rows = 0
                del chunk[:]
                if size > HELD:
                    yield out()
                    held.clear()
                    size = 0
        if rows:
            add()
        if held:
            yield out()

    return run


def _merge_runs(n_keys: int, names: list[str]):
    """Merge sketches of equal keys in a partition sorted by key; one sketch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, types = None, None, []
        done: list[tuple] = []

        def close() -> None:
            if now is not None:
                done.append((*key, now.to_bytes() if isinstance(now, RelativeSketch) else now))

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            types = [*(c.type for c in b.columns[:n_keys]), pa.binary()]
            columns = [c.to_pylist() for c in (*b.columns[:n_keys], b.column(n_keys))]
            for *row, raw in zip(*columns, strict=True):
                if now is None or row != key:
                    close()
                    key, now = row, raw
                    if len(done) >= 256:
                        yield out()
                        done.clear()
                else:
                    if not isinstance(now, RelativeSketch):
                        now = RelativeSketch.from_bytes(now, seed=len(now))
                    now.merge(RelativeSketch.from_bytes(raw))
        close()
        if done:
            yield out()

    return run


def merge_sketches(df: DataFrame, keys: Sequence[str], sketch: str = "sketch") -> DataFrame:
    """One sketch per combination of ``keys``: from days, partitions or earlier merges.

    The sketches of a key are first merged in ``FAN_IN`` groups by their hash and then these, so a key with
    very many of them isn't left to one task. Sorting by the sketch too makes a repeated task give the same.
    """
    n, binary = len(keys), T.StructField(sketch, T.BinaryType())
    kept = [df.schema[k] for k in keys]
    salt = T.StructField("_salt", T.IntegerType())
    salted = df.select(*keys, F.pmod(F.xxhash64(sketch), F.lit(FAN_IN)).cast("int").alias("_salt"), sketch)
    half = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", sketch)
    half = half.mapInArrow(_merge_runs(n + 1, [*keys, "_salt", sketch]), T.StructType([*kept, salt, binary])).select(*keys, sketch)
    whole = half.repartition(*keys).sortWithinPartitions(*keys, sketch)
    return whole.mapInArrow(_merge_runs(n, [*keys, sketch]), T.StructType([*kept, binary]))


def sketch_table(df: DataFrame, keys: Sequence[str], value: str, high: bool = True, section: int = SECTION) -> DataFrame:
    """A sketch of ``value`` for each combination of ``keys``: the keys and ``sketch`` (binary).

    Null and NaN values are left out, infinite ones count, -0.0 counts as 0.0; null keys form keys of their
    own; repeated rows count each; other columns are ignored; an empty table gives no rows. Partitions send
    sketches, not rows, so a key with most of the rows costs no more than others.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_value"))
    if not keys:
        raise ValueError("at least one key is needed")
    names = [*keys, "_value"]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("sketch", T.BinaryType())])
    partial = rows.mapInArrow(_sketch(len(keys), names, high, section), schema)
    return merge_sketches(partial, keys)


def read_sketches(df: DataFrame, keys: Sequence[str], quantiles: dict[str, float], ranks: dict[str, tuple[float, bool]] | None = None, sketch: str = "sketch") -> DataFrame:
    """The keys, ``n``, ``exact`` (nothing was compacted), ``slack`` (of the ranks), a column for each quantile and
    for each rank (value, inclusive)."""
    ranks = ranks or {}
    fields = [T.StructField("n", T.LongType()), T.StructField("exact", T.BooleanType()), T.StructField("slack", T.DoubleType())]
    fields += [T.StructField(c, T.DoubleType()) for c in quantiles] + [T.StructField(c, T.LongType()) for c in ranks]
    schema = T.StructType([*(df.schema[k] for k in keys), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [RelativeSketch.from_bytes(r) for r in b.column(len(keys)).to_pylist()]
            cols = [pa.array([s.n for s in found], pa.int64()), pa.array([s.exact for s in found], pa.bool_()), pa.array([s.slack() for s in found], pa.float64())]
            cols += [pa.array([s.quantile(q) for s in found], pa.float64()) for q in quantiles.values()]
            cols += [pa.array([s.rank(*r) for s in found], pa.int64()) for r in ranks.values()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *cols], names=schema.names)

    return df.select(*keys, sketch).mapInArrow(run, schema)
