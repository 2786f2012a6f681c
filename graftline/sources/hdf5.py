"""Vectors from HDF5 files: a data source for two-dimensional numeric datasets.

``spark.dataSource.register(HDF5Source)``, then ``spark.read.format("hdf5").option("dataset", "train").load(path)`` gives
``row_id long, <dataset> array<float>``. Every partition reads its own rows. The file's structure is read here, from
the published format: superblocks 0 to 3, groups with symbol tables or compact links, and datasets of integers or
floats stored contiguously or, in the older chunk index, in chunks that may be deflated and shuffled. A path may name a folder: its files follow each other by name.

``write_hdf5`` writes such a folder, a file for each partition.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graftline.operators.pairs import matrix
from graftline.session import parallelism

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF
# Numbers of the header messages that are read
SPACE, TYPE, LINK, LAYOUT, FILTERS, MORE, TABLE = 0x01, 0x03, 0x06, 0x08, 0x0B, 0x10, 0x11
ROWS = 8192  # of a batch
PART_BYTES = 32 << 20


def open_file(path: str):
    """A random-access file of a path or URI."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parts.path) if parts.scheme else path)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    fs, inner = pafs.FileSystem.from_uri(path.replace(f"{parts.scheme}://", f"{scheme}://", 1))
    return fs.open_input_file(inner)


@dataclass
class Dataset:
    """Where and how the numbers of a dataset lie."""

    shape: tuple[int, ...]
    kind: np.dtype
    address: int = NOWHERE  # of the numbers, or of the chunk index
    chunk: tuple[int, ...] = ()
    filters: list[int] = field(default_factory=list)
    inline: bytes | None = None


class File:
    """The objects of an open HDF5 file."""

    def __init__(self, source):
        self.source = source
        head = self._at(0, 128)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        if version < 2:
            if head[13:15] != b"\x08\x08":
                raise ValueError("only addresses of 8 bytes are read")
            entry = 24 + 4 * version + 32
            self.root = struct.unpack_from("<Q", head, entry + 8)[0]
        else:
            if head[9:11] != b"\x08\x08":
                raise ValueError("only addresses of 8 bytes are read")
            self.root = struct.unpack_from("<Q", head, 12 + 24)[0]

    def _at(self, address: int, size: int) -> bytes:
        self.source.seek(address)
        return self.source.read(size)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """Type and content of the messages of an object's header."""
        head = self._at(address, 16)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._at(address + at, width), "little")
            blocks, extra, prefix = [(address + at + width, size)], 2 * bool(flags & 4), 4
        else:
            if head[0] != 1:
                raise ValueError("unknown object header")
            blocks, extra, prefix = [(address + 16, struct.unpack_from("<I", head, 8)[0])], 0, 8
        while blocks:
            start, size = blocks.pop(0)
            raw, at = self._at(start, size), 0
            if raw[:4] == b"OCHK":
                raw, at = raw[:-4], 4
            while at + prefix + extra <= len(raw):
                kind, length = (raw[at], struct.unpack_from("<H", raw, at + 1)[0]) if prefix == 4 else struct.unpack_from("<HH", raw, at)
                body = raw[at + prefix + extra : at + prefix + extra + length]
                at += prefix + extra + length
                if kind == MORE:
                    blocks.append(struct.unpack_from("<QQ", body))
                else:
                    out.append((kind, body))
        return out

    def members(self, address: int) -> dict[str, int]:
        """Names and header addresses of a group's members."""
        out: dict[str, int] = {}
        for kind, body in self.messages(address):
            if kind == LINK:
                name, where = self._link(body)
                out[name] = where
            elif kind == TABLE:
                tree, heap = struct.unpack_from("<QQ", body)
                size, _, data = struct.unpack_from("<QQQ", self._at(heap, 32), 8)
                self._symbols(tree, self._at(data, size), out)
        return out

    @staticmethod
    def _link(body: bytes) -> tuple[str, int]:
        flags = body[1]
        at = 2 + bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
        width = 1 << (flags & 3)
        size = int.from_bytes(body[at : at + width], "little")
        name = body[at + width : at + width + size].decode()
        hard = not (flags & 8) or body[2] == 0
        return name, struct.unpack_from("<Q", body, at + width + size)[0] if hard else NOWHERE

    def _symbols(self, address: int, names: bytes, out: dict[str, int]) -> None:
        head = self._at(address, 8)
        if head[:4] == b"TREE":
            used = struct.unpack_from("<H", head, 6)[0]
            raw = self._at(address + 24, 16 * used + 8)
            for n in range(used):
                self._symbols(struct.unpack_from("<Q", raw, 16 * n + 8)[0], names, out)
            return
        count = struct.unpack_from("<H", head, 6)[0]
        raw = self._at(address + 8, 40 * count)
        for n in range(count):
            name, where = struct.unpack_from("<QQ", raw, 40 * n)
            out[names[name : names.index(b"\0", name)].decode()] = where

    def dataset(self, path: str) -> Dataset:
        """The dataset of a path such as ``/train``."""
        address = self.root
        for part in path.strip("/").split("/"):
            address = self.members(address).get(part, NOWHERE)
            if address == NOWHERE:
                raise ValueError(f"no dataset {path}")
        found = {}
        for kind, body in self.messages(address):
            found.setdefault(kind, body)
        if not {SPACE, TYPE, LAYOUT} <= found.keys():
            raise ValueError(f"{path} is not a dataset")
        space, kind, layout = found[SPACE], found[TYPE], found[LAYOUT]
        shape = struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)
        cls, order, size = kind[0] & 15, ">" if kind[1] & 1 else "<", struct.unpack_from("<I", kind, 4)[0]
        if cls > 1:
            raise ValueError("only integers and floats are read")
        out = Dataset(shape, np.dtype(f"{order}{'f' if cls else 'i' if kind[1] & 8 else 'u'}{size}"))
        if layout[0] not in (3, 4) or layout[0] == 4 and layout[1] == 2:
            raise ValueError("unknown layout")
        if layout[1] == 0:
            out.inline = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
        elif layout[1] == 1:
            out.address = struct.unpack_from("<Q", layout, 2)[0]
        else:
            out.address = struct.unpack_from("<Q", layout, 3)[0]
            out.chunk = struct.unpack_from(f"<{layout[2] - 1}I", layout, 11)
            out.filters = self._filters(found.get(FILTERS, b""))
        return out

    @staticmethod
    def _filters(body: bytes) -> list[int]:
        out, at = [], 8 if body[:1] == b"\1" else 2
        for _ in range(body[1] if body else 0):
            number = struct.unpack_from("<H", body, at)[0]
            named = body[0] == 1 or number >= 256
            name = struct.unpack_from("<H", body, at + 2)[0] if named else 0
            values = struct.unpack_from("<H", body, at + (6 if named else 4))[0]
            at += (8 if named else 6) + name + 4 * values + (4 * (values % 2) if body[0] == 1 else 0)
            out.append(number)
        if set(out) - {1, 2}:
            raise ValueError("only deflated and shuffled chunks are read")
        return out

    def _chunks(self, address: int, rank: int, lo: int, hi: int, rows: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Offsets, address, size and skipped filters of the chunks that hold rows lo to hi."""
        head = self._at(address, 8)
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        key = 8 + 8 * (rank + 1)
        raw = self._at(address + 24, used * (key + 8) + key)
        for n in range(used):
            at = n * (key + 8)
            size, mask = struct.unpack_from("<II", raw, at)
            place = struct.unpack_from(f"<{rank}Q", raw, at + 8)
            child = struct.unpack_from("<Q", raw, at + key)[0]
            after = struct.unpack_from("<Q", raw, at + key + 16)[0]
            if level:
                if place[0] < hi and after + rows > lo:
                    yield from self._chunks(child, rank, lo, hi, rows)
            elif place[0] < hi and place[0] + rows > lo:
                yield place, child, size, mask

    def rows(self, data: Dataset, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi of a dataset."""
        width = math.prod(data.shape[1:])
        if data.inline is not None:
            return np.frombuffer(data.inline, data.kind).reshape(data.shape)[lo:hi]
        if not data.chunk:
            if data.address == NOWHERE:  # never written: zeros
                return np.zeros((hi - lo, *data.shape[1:]), data.kind)
            size = width * data.kind.itemsize
            return np.frombuffer(self._at(data.address + lo * size, (hi - lo) * size), data.kind).reshape(hi - lo, *data.shape[1:])
        out = np.zeros((hi - lo, *data.shape[1:]), data.kind)
        if data.address == NOWHERE:
            return out
        for place, address, size, mask in self._chunks(data.address, len(data.shape), lo, hi, data.chunk[0]):
            raw = self._at(address, size)
            for n in range(len(data.filters) - 1, -1, -1):
                if mask >> n & 1:
                    continue
                if data.filters[n] == 1:
                    raw = zlib.decompress(raw)
                else:
                    raw = np.frombuffer(raw, np.uint8).reshape(data.kind.itemsize, -1).T.tobytes()
            block = np.frombuffer(raw, data.kind).reshape(data.chunk)
            first, last = max(lo, place[0]), min(hi, place[0] + data.chunk[0], data.shape[0])
            cut = [slice(first - place[0], last - place[0]), *(slice(0, min(c, n - p)) for c, n, p in zip(data.chunk[1:], data.shape[1:], place[1:], strict=True))]
            out[(slice(first - lo, last - lo), *(slice(p, p + s.stop) for p, s in zip(place[1:], cut[1:], strict=True)))] = block[tuple(cut)]
        return out


def extents(path: str, dataset: str) -> tuple[int, ...]:
    """The shape of a dataset."""
    with open_file(path) as source:
        return File(source).dataset(dataset).shape


def listed(path: str) -> list[str]:
    """The file of a path, or the files of a folder in order of their names."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        local = unquote(parts.path) if parts.scheme else path
        found = pafs.LocalFileSystem().get_file_info(pafs.FileSelector(local)) if pafs.LocalFileSystem().get_file_info(local).type == pafs.FileType.Directory else None
        return [path] if found is None else sorted(f.path for f in found if f.path.endswith((".hdf5", ".h5")))
    return [path]


def _message(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _header(*messages: bytes) -> bytes:
    raw = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(raw)) + raw


def head_of(shape: tuple[int, int], dataset: str) -> bytes:
    """Everything of a file with one contiguous dataset of 4-byte floats but its numbers, which follow."""
    size = shape[0] * shape[1] * 4
    space = struct.pack("<BBB5xQQ", 1, 2, 0, *shape)
    kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 31, 0, 4, 0, 32, 23, 8, 0, 23, 127)
    name = dataset.encode()
    names = b"\0" * 8 + name + b"\0" * (8 - len(name) % 8)

    def data_header(address: int) -> bytes:
        return _header(_message(SPACE, space), _message(TYPE, kind), _message(LAYOUT, struct.pack("<BBQQ", 3, 1, address, size)))

    data = 96
    heap = data + len(data_header(0))
    node = heap + 32 + len(names)
    tree = node + 8 + 40
    root = tree + 24 + 24
    table = _header(_message(TABLE, struct.pack("<QQ", tree, heap)))
    start = root + len(table)
    top = SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, start + size, NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
    body = data_header(start) + b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, heap + 32) + names
    body += b"SNOD" + struct.pack("<BxH", 1, 1) + struct.pack("<QQII16x", 8, data, 0, 0)
    body += b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, NOWHERE, NOWHERE, 0, node, 8)
    return top + body + table


def write_hdf5(df: DataFrame, order: str, vector: str, path: str, dataset: str = "train") -> None:
    """Write vectors in the order of a column, a file for each range of it; ids aren't kept. Null vectors and vectors of
    different lengths are an error. A task that is repeated writes the same file."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError("only mounted folders are written")
    folder = unquote(where.path) if where.scheme else path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0)).astype("<f4") for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            local = pafs.LocalFileSystem()
            local.create_dir(folder)
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}.hdf5"
            with local.open_output_stream(f"{name}.tmp{TaskContext.get().taskAttemptId()}") as out:
                out.write(head_of(x.shape, dataset) + x.tobytes())
            local.move(f"{name}.tmp{TaskContext.get().taskAttemptId()}", name)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64())], names=["n"])

    spark = df.sparkSession
    ranged = df.select(order, F.col(vector).cast("array<float>").alias(vector)).repartitionByRange(parallelism(spark), order).sortWithinPartitions(order)
    ranged.select(vector).mapInArrow(run, "n long").agg(F.sum("n")).collect()


@dataclass
class Rows(InputPartition):
    path: str
    first: int  # row of the whole that is row 0 of the file
    lo: int
    hi: int


class HDF5Reader(DataSourceReader):
    def __init__(self, path: str, dataset: str):
        self.path, self.dataset = path, dataset

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for path in listed(self.path):
            with open_file(path) as source:
                data = File(source).dataset(self.dataset)
            step = max(1, PART_BYTES // max(1, math.prod(data.shape[1:]) * data.kind.itemsize))
            if data.chunk:
                step = max(1, round(step / data.chunk[0])) * data.chunk[0]
            out += [Rows(path, first, s, min(s + step, data.shape[0])) for s in range(0, data.shape[0], step)]
            first += data.shape[0]
        return out or [Rows(self.path, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.lo == partition.hi:
            return
        with open_file(partition.path) as source:
            file = File(source)
            data = file.dataset(self.dataset)
            for lo in range(partition.lo, partition.hi, ROWS):
                hi = min(lo + ROWS, partition.hi)
                x = np.ascontiguousarray(file.rows(data, lo, hi), np.float32).reshape(hi - lo, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                ids = np.arange(partition.first + lo, partition.first + hi, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["row_id", self.dataset.strip("/").split("/")[-1]])


class HDF5Source(DataSource):
    """Options: ``path`` and ``dataset`` (default train), which must have one or two dimensions."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        column = self.options.get("dataset", "train").strip("/").split("/")[-1]
        return f"row_id long, `{column}` array<float>"

    def reader(self, schema) -> DataSourceReader:
        dataset = self.options.get("dataset", "train")
        if any(len(extents(p, dataset)) > 2 for p in listed(self.options["path"])):
            raise ValueError("the dataset must have one or two dimensions")
        return HDF5Reader(self.options["path"], dataset)
