"""Files are written here byte by byte from the published format, as no HDF5 library is installed."""

import struct
import zlib

import numpy as np
import pytest

from graftline.sources.hdf5 import SIGNATURE, HDF5Source, extents


def message(kind, body):
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def header(messages):
    raw = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(raw)) + raw


def dataset_header(x, layout, filters=b""):
    space = struct.pack("<BBB5x", 1, x.ndim, 0) + struct.pack(f"<{x.ndim}Q", *x.shape)
    kind = struct.pack("<BBBBI", 0x11 if x.dtype.kind == "f" else 0x10, 0x20 if x.dtype.kind == "f" else 0x08, 31, 0, x.dtype.itemsize) + bytes(12)
    return header([message(1, space), message(3, kind), message(8, layout), *([message(0x0B, filters)] if filters else [])])


class Builder:
    def __init__(self):
        self.raw = bytearray(96)

    def put(self, data):
        at = len(self.raw)
        self.raw += data + b"\0" * (-len(data) % 8)
        return at

    def finish(self, name, head, path):
        """A root group with a symbol table of one member."""
        names = self.put(b"\0" * 8 + name.encode() + b"\0" * 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, 64, NOWHERE, names))
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, 1) + struct.pack("<QQII16x", 8, head, 0, 0))
        tree = self.put(b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, NOWHERE, NOWHERE, 0, node, 8))
        root = self.put(header([message(0x11, struct.pack("<QQ", tree, heap))]))
        top = SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.raw), NOWHERE)
        self.raw[:96] = top + struct.pack("<QQII16x", 0, root, 0, 0)
        path.write_bytes(bytes(self.raw))
        return str(path)


NOWHERE = 0xFFFFFFFFFFFFFFFF


def contiguous(x, path, name="train"):
    b = Builder()
    at = b.put(x.tobytes())
    return b.finish(name, b.put(dataset_header(x, struct.pack("<BBQQ", 3, 1, at, x.nbytes))), path)


def chunked(x, chunk, path, filters):
    b = Builder()
    keys = b""
    count = 0
    for r in range(0, x.shape[0], chunk[0]):
        for c in range(0, x.shape[1], chunk[1]):
            block = np.zeros(chunk, x.dtype)
            part = x[r : r + chunk[0], c : c + chunk[1]]
            block[: part.shape[0], : part.shape[1]] = part
            raw = block.tobytes()
            if 2 in filters:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
            if 1 in filters:
                raw = zlib.compress(raw)
            keys += struct.pack("<IIQQQQ", len(raw), 0, r, c, 0, b.put(raw))
            count += 1
    tree = b.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, count, NOWHERE, NOWHERE) + keys + struct.pack("<IIQQQ", 0, 0, x.shape[0], 0, 0))
    pipeline = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", 4, 0) for f in filters)
    return b.finish("train", b.put(dataset_header(x, struct.pack("<BBBQIII", 3, 2, 3, tree, *chunk, x.dtype.itemsize), pipeline if filters else b"")), path)


def loaded(spark, path, dataset="train"):
    spark.dataSource.register(HDF5Source)
    rows = spark.read.format("hdf5").option("dataset", dataset).load(path).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(rows)))
    return np.array([r[1] for r in rows])


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i4"])
def test_contiguous(spark, tmp_path, kind, monkeypatch):
    x = (np.random.default_rng(0).standard_normal((1000, 7)) * 50).astype(kind)
    path = contiguous(x, tmp_path / "a.hdf5")
    assert extents(path, "/train") == (1000, 7)
    assert (loaded(spark, path) == x.astype(np.float32)).all()
    monkeypatch.setattr("graftline.sources.hdf5.PART_BYTES", 4000)
    assert spark.read.format("hdf5").load(path).count() == 1000


@pytest.mark.parametrize("filters", [[], [1], [2, 1]])
def test_chunks(spark, tmp_path, filters):
    x = np.random.default_rng(1).standard_normal((530, 10)).astype("<f4")
    assert (loaded(spark, chunked(x, (64, 4), tmp_path / "a.hdf5", filters)) == x).all()


def test_compact_links_of_newer_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    b = Builder()
    at = b.put(x.tobytes())
    head = b.put(dataset_header(x, struct.pack("<BBQQ", 3, 1, at, x.nbytes)))
    link = struct.pack("<BBB", 1, 0, 5) + b"train" + struct.pack("<Q", head)
    body = struct.pack("<BHB", 6, len(link), 0) + link
    root = b.put(b"OHDR" + struct.pack("<BBB", 2, 0, len(body)) + body + bytes(4))
    b.raw[:48] = SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NOWHERE, len(b.raw), root, 0)
    path = tmp_path / "new.hdf5"
    path.write_bytes(bytes(b.raw))
    assert (loaded(spark, str(path)) == x).all()


def test_no_rows_and_errors(spark, tmp_path):
    path = contiguous(np.empty((0, 5), "<f4"), tmp_path / "a.hdf5")
    assert len(loaded(spark, path)) == 0
    with pytest.raises(ValueError, match="no dataset"):
        extents(path, "test")
    (tmp_path / "b").write_bytes(b"x" * 200)
    with pytest.raises(ValueError, match="not an HDF5"):
        extents(str(tmp_path / "b"), "train")
