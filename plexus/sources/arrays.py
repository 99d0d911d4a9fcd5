"""Array files as a Spark data source that reads byte ranges: ``.npy``, sparse ``.npz``, and MAT files of level 5.

Only headers are read while a query is planned. What is stored plainly is split by ranges of rows or entries, so a
file may be of any size and a task holds one batch of its range. Deflated members can only be read from
their beginning: one task streams such a member, a batch at a time.
"""

from __future__ import annotations

import ast
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plexus.session import ship

NAME = "plexus_array"
#: Bytes of stored numbers that a partition has, and that a batch holds, about.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
# Fixed values of the MAT format: types of numbers, and classes of arrays.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_SPARSE, MAT_NUMBERS = 14, 15, 5, range(6, 16)


def opened(path: str):
    """A file for random access, of any store that Arrow knows by its address."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, at = fs.FileSystem.from_uri(path)
        return store.open_input_file(at)
    return open(path, "rb")


@dataclass(frozen=True)
class Numbers:
    """Equal numbers in a row: in the file at ``at``, or within the stream that ``inner`` names at its byte ``at``."""

    dtype: str
    n: int
    at: int
    inner: str | int | None = None  # a member of a zip file, or where a deflated element begins


@dataclass(frozen=True)
class Layout:
    """A matrix in a file: dense, or the pointers, indices and values of its compressed rows or columns."""

    rows: int
    cols: int
    by_column: bool
    dense: Numbers | None = None
    pointers: Numbers | None = None
    indices: Numbers | None = None
    values: Numbers | None = None

    @property
    def streamed(self) -> bool:
        return any(x is not None and x.inner is not None for x in (self.dense, self.pointers, self.indices, self.values))


def npy_header(f) -> tuple[str, bool, tuple[int, ...], int]:
    """(dtype, column by column, shape, bytes of the header) from the start of an ``.npy`` stream."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = magic[6] > 1
    size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
    head = ast.literal_eval(f.read(size).decode("latin-1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"numbers are needed, not {kind}")
    return kind.str, bool(head["fortran_order"]), tuple(head["shape"]), 8 + (4 if wide else 2) + size


def npy_layout(path: str) -> Layout:
    with opened(path) as f:
        kind, fortran, shape, at = npy_header(f)
    rows, cols = (shape or (1,))[0], int(np.prod(shape[1:], dtype=np.int64))
    if fortran and len(shape) > 2:
        raise ValueError("at most two dimensions by column")
    return Layout(rows, cols, fortran and len(shape) == 2, Numbers(kind, rows * cols, at))


def npz_layout(path: str) -> Layout:
    """Of a sparse matrix by compressed rows or columns (indptr, indices, shape, format, and data if it has any)."""
    found: dict[str, Numbers] = {}
    with opened(path) as f, zipfile.ZipFile(f) as z:
        if "format.npy" in z.namelist():
            with z.open("format.npy") as m:
                m.read(8)
                m.read(struct.unpack("<H", m.read(2))[0])
                kind = m.read().replace(b"\x00", b"").decode()
            if kind not in ("csr", "csc"):
                raise ValueError(f"compressed rows or columns are needed, not {kind}")
        else:
            kind = "csr"
        for name in z.namelist():
            part = name.removesuffix(".npy")
            if part not in ("indptr", "indices", "data", "shape"):
                continue
            with z.open(name) as m:
                dtype, _, shape, at = npy_header(m)
                if part == "shape":
                    whole = np.frombuffer(m.read(), dtype)
            info = z.getinfo(name)
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset)
                local = f.read(30)
                start = info.header_offset + 30 + sum(struct.unpack("<HH", local[26:30]))
                found[part] = Numbers(dtype, int(np.prod(shape)), start + at)
            else:
                found[part] = Numbers(dtype, int(np.prod(shape)), at, name)
        majors = found["indptr"].n - 1
        rows, cols = (int(whole[0]), int(whole[1])) if "shape" in found else (majors, -1)
    return Layout(rows, cols, kind == "csc", None, found["indptr"], found["indices"], found.get("data"))


class _Stream:
    """Reads on in bytes that are stored plainly or deflated."""

    def __init__(self, f, at: int, deflated: bool = False):
        self.f, self.left, self.tool = f, b"", zlib.decompressobj() if deflated else None
        f.seek(at)

    def read(self, n: int) -> bytes:
        if self.tool is None:
            return self.f.read(n)
        while len(self.left) < n and not self.tool.eof:
            data = self.tool.unconsumed_tail or self.f.read(1 << 16)
            if not data:
                break
            self.left += self.tool.decompress(data, max(1 << 16, n - len(self.left)))
        out, self.left = self.left[:n], self.left[n:]
        return out

    def skip(self, n: int) -> None:
        if self.tool is None:
            self.f.seek(n, 1)
            return
        while n > 0:
            n -= len(self.read(min(n, 1 << 20))) or n


def mat_layout(path: str, variable: str) -> Layout:
    """Of one variable of a MAT file, dense numbers or sparse, real, of two dimensions."""
    with opened(path) as f:
        head = f.read(128)
        if len(head) < 128 or head[124:128] not in (b"\x00\x01IM", b"\x01\x00MI"):
            raise ValueError("no MAT file of level 5")
        order = "<" if head[126:128] == b"IM" else ">"
        at = 128
        while True:
            f.seek(at)
            tag = f.read(8)
            if len(tag) < 8:
                raise ValueError(f"no variable {variable}")
            kind, size = struct.unpack(order + "II", tag)
            layout = None
            if kind == MAT_COMPRESSED:
                s = _Stream(f, at + 8, True)
                inner = struct.unpack(order + "II", s.read(8))[0]
                layout = _mat_matrix(s, 8, order, variable, at + 8) if inner == MAT_MATRIX else None
            elif kind == MAT_MATRIX:
                layout = _mat_matrix(_Stream(f, at + 8), at + 8, order, variable, None)
            if layout is not None:
                return layout
            at += 8 + size + (0 if kind == MAT_COMPRESSED else -size % 8)


def _mat_matrix(s: _Stream, at: int, order: str, variable: str, inner: int | None) -> Layout | None:
    """The layout of the matrix whose elements start here; None if it has another name."""

    def element(read: bool):
        nonlocal at
        tag = s.read(8)
        kind, size = struct.unpack(order + "II", tag)
        if kind >> 16:  # a small element: type and size share a word, and the data are in the tag
            size, kind = kind >> 16, kind & 0xFFFF
            out = (kind, size, at + 4, tag[4 : 4 + size])
            at += 8
            return out
        out = (kind, size, at + 8, s.read(size) if read else None)
        if not read:
            s.skip(size)
        s.skip(-size % 8)
        at += 8 + size + -size % 8
        return out

    flags = struct.unpack(order + "II", element(True)[3])
    dims = np.frombuffer(element(True)[3], order + "i4")
    if element(True)[3].decode("latin-1") != variable:
        return None
    if len(dims) != 2 or flags[0] & 0x800 or (flags[0] & 0xFF) not in (MAT_SPARSE, *MAT_NUMBERS):
        raise ValueError(f"{variable}: a real matrix of two dimensions is needed")
    numbers = lambda e: Numbers(order + MAT_TYPES[e[0]], e[1] // np.dtype(MAT_TYPES[e[0]]).itemsize, e[2], inner)
    rows, cols = int(dims[0]), int(dims[1])
    if (flags[0] & 0xFF) != MAT_SPARSE:
        return Layout(rows, cols, True, numbers(element(False)))
    indices, pointers = numbers(element(False)), numbers(element(False))
    return Layout(rows, cols, True, None, pointers, indices, numbers(element(False)))


class _Reader:
    """Reads stretches of a file's numbers; those of a stream only forwards."""

    def __init__(self, path: str):
        self.path, self.files, self.streams = path, [], {}

    def _open(self):
        self.files.append(opened(self.path))
        return self.files[-1]

    def get(self, what: Numbers, start: int, n: int) -> np.ndarray:
        kind = np.dtype(what.dtype)
        n = max(0, min(n, what.n - start))
        if what.inner is None:
            f = self.files[0] if self.files else self._open()
            f.seek(what.at + start * kind.itemsize)
            return np.frombuffer(f.read(n * kind.itemsize), kind)
        if what not in self.streams:
            stream = zipfile.ZipFile(self._open()).open(what.inner) if isinstance(what.inner, str) else _Stream(self._open(), what.inner, True)
            self.streams[what] = [stream, 0]
        held = self.streams[what]
        to = what.at + start * kind.itemsize
        while held[1] < to:
            held[1] += len(held[0].read(min(1 << 20, to - held[1])))
        data = held[0].read(n * kind.itemsize)
        while len(data) < n * kind.itemsize and (more := held[0].read(n * kind.itemsize - len(data))):
            data += more
        held[1] += len(data)
        return np.frombuffer(data, kind)

    def close(self) -> None:
        for f in self.files:
            f.close()


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    start: int
    end: int

    def __init__(self, path: str, layout: Layout, start: int, end: int):
        self.path, self.layout, self.start, self.end = path, layout, start, end


def entries(p: Range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of a range of stored entries, a batch at a time; zeros are left out of sparse ones."""
    r, own = _Reader(p.path), p.layout
    step = max(1, BATCH_BYTES // 24)
    try:
        if own.dense is not None:
            width = max(1, own.rows if own.by_column else own.cols)
            for at in range(p.start, p.end, step):
                v = r.get(own.dense, at, min(step, p.end - at)).astype(float)
                place = np.arange(at, at + len(v))
                major, minor = place // width, place % width
                yield (minor, major, v) if own.by_column else (major, minor, v)
            return
        # The last pointer at or below the range's first entry, then pointers in step with the entries.
        lo = 0
        if own.pointers.inner is None:
            hi = own.pointers.n - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if int(r.get(own.pointers, mid, 1)[0]) <= p.start else (lo, mid - 1)
        held, first = np.zeros(0, np.int64), lo
        for at in range(p.start, p.end, step):
            n = min(step, p.end - at)
            while not len(held) or (held[-1] < at + n and first + len(held) < own.pointers.n):
                more = r.get(own.pointers, first + len(held), step).astype(np.int64)
                if not len(more):
                    break
                held = np.concatenate((held, more))
            place = np.arange(at, at + n)
            major = first + np.searchsorted(held, place, side="right") - 1
            minor = r.get(own.indices, at, n).astype(np.int64)
            v = r.get(own.values, at, n).astype(float) if own.values is not None else np.ones(n)
            drop = max(0, int(major[-1]) - first) if n else 0
            held, first = held[drop:], first + drop
            some = v != 0
            yield (minor[some], major[some], v[some]) if own.by_column else (major[some], minor[some], v[some])
    finally:
        r.close()


def lines(p: Range, columns: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first one, lines by numbers) of a range of rows, or of columns, of a dense matrix."""
    r, own = _Reader(p.path), p.layout
    n, width = (own.cols, own.rows) if columns else (own.rows, own.cols)
    step = max(1, BATCH_BYTES // (8 * max(1, width)))
    try:
        for at in range(p.start, p.end, step):
            k = min(step, p.end - at)
            if own.by_column == columns:
                yield at, r.get(own.dense, at * width, k * width).astype(float).reshape(k, width)
            else:
                yield at, np.stack([r.get(own.dense, j * n + at, k).astype(float) for j in range(width)], axis=1) if width else np.zeros((k, 0))
    finally:
        r.close()


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "rows")
        self.kind, self.variable = options["kind"], options.get("variable", "")
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Range]:
        own = {"npy": npy_layout, "npz": npz_layout, "mat": lambda p: mat_layout(p, self.variable)}[self.kind](self.path)
        if self.layout == "entries":
            stored = own.dense or own.indices
            n, size = stored.n, 24
        else:
            if own.dense is None:
                raise ValueError("a sparse matrix is read by entries")
            n, width = (own.cols, own.rows) if self.layout == "columns" else (own.rows, own.cols)
            if own.streamed and own.by_column != (self.layout == "columns"):
                raise ValueError("a deflated matrix is read in the order it is stored in, or by entries")
            size = np.dtype(own.dense.dtype).itemsize * width
        step = n if own.streamed else max(1, self.bytes // max(1, size))
        return [Range(self.path, own, at, min(n, at + step)) for at in range(0, max(1, n), max(1, step))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.layout == "entries":
            for r, c, v in entries(partition):
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.float64())], ["row", "col", "value"])
            return
        for at, block in lines(partition, self.layout == "columns"):
            k, width = block.shape
            values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * width, pa.int32()), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + k), pa.int64()), values], ["row", "values"])


class ArrayFiles(DataSource):
    """Options: path, kind (npy, npz, mat), layout (rows, columns, entries), variable (of a MAT file), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "row bigint, col bigint, value double" if self.options.get("layout") == "entries" else "row bigint, values array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def read_array(spark: SparkSession, path: str, kind: str, layout: str = "rows", variable: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(row, values) of a dense matrix by rows or columns, or (row, col, value) of any by entries."""
    ship(spark)
    spark.dataSource.register(ArrayFiles)
    return spark.read.format(NAME).options(path=path, kind=kind, layout=layout, variable=variable, partitionBytes=str(partition_bytes)).load()


def read_mat_graph(spark: SparkSession, path: str, label: str = "label", edges: str = "edge_index", features: str = "node_feat") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((src, dst), (id, y), (id, col, value)) of a graph in a MAT file: edges of two rows, a label a node, dense or sparse features."""
    pair = read_array(spark, path, "mat", "columns", edges)
    of = lambda i: F.get("values", F.lit(i)).cast("bigint")
    # One label a node, in a row or in a column: the larger of the two places is its node.
    labels = read_array(spark, path, "mat", "entries", label).select(F.greatest("row", "col").alias("id"), F.col("value").cast("bigint").alias("y"))
    return pair.select(of(0).alias("src"), of(1).alias("dst")), labels, read_array(spark, path, "mat", "entries", features).withColumnRenamed("row", "id")


def read_csr_edges(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(src, dst), distinct, of a sparse matrix in an ``.npz`` file; zeros are no edges."""
    return read_array(spark, path, "npz", "entries", partition_bytes=partition_bytes).select(F.col("row").alias("src"), F.col("col").alias("dst")).distinct()
