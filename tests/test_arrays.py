"""Array files read by byte ranges."""

import struct
import zlib

import numpy as np
import pytest

from plexus.sources import arrays as A

KINDS = {"f8": (9, 6), "f4": (7, 7), "i4": (5, 12), "u1": (2, 9)}  # types of numbers and classes


def element(kind, data):
    if len(data) <= 4:
        return struct.pack("<HH", kind, len(data)) + data.ljust(4, b"\0")
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, a=None, sparse=None, small=None, deflate=False):
    """One variable of a MAT file; sparse: (shape, pointers, indices, values) by columns."""
    if sparse is None:
        a = np.atleast_2d(a)
        kind, cls = KINDS[a.dtype.str[1:]]
        body = element(6, struct.pack("<II", cls, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode())
        body += element(2, a.astype("u1").tobytes("F")) if small else element(kind, a.tobytes("F"))
    else:
        shape, jc, ir, pr = sparse
        body = element(6, struct.pack("<II", 5, len(ir))) + element(5, np.array(shape, "<i4").tobytes()) + element(1, name.encode())
        body += element(5, np.array(ir, "<i4").tobytes()) + element(5, np.array(jc, "<i4").tobytes()) + element(9, np.array(pr, "<f8").tobytes())
    whole = struct.pack("<II", 14, len(body)) + body
    if not deflate:
        return whole
    data = zlib.compress(whole)
    return struct.pack("<II", 15, len(data)) + data


def mat(path, *parts):
    path.write_bytes(b"test".ljust(124) + b"\x00\x01IM" + b"".join(parts))
    return str(path)


def csc(a):
    jc, ir, pr = [0], [], []
    for j in range(a.shape[1]):
        rows = np.flatnonzero(a[:, j])
        ir += rows.tolist()
        pr += a[rows, j].tolist()
        jc.append(len(ir))
    return a.shape, jc, ir, pr


def rows(df):
    return np.array([r["values"] for r in df.orderBy("row").collect()])


def filled(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] += r["value"]
    return out


def test_npy_files_are_split_by_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    for a in (rng.normal(size=(500, 7)), rng.normal(size=(500, 7)).astype("f4"), np.asfortranarray(rng.integers(0, 99, (300, 5))), rng.integers(0, 9, 400), rng.random((40, 3)) < 0.5, np.zeros((0, 4))):
        path = f"{tmp_path}/a.npy"
        np.save(path, a)
        got = A.read_array(spark, path, "npy", partition_bytes=2000)
        if len(a):
            two = a.reshape(len(a), -1)
            assert got.rdd.getNumPartitions() > 1 or a.nbytes < 2000
            assert (rows(got) == two).all()
            assert (rows(A.read_array(spark, f"file://{path}", "npy", "columns")) == two.T).all()
            assert (filled(A.read_array(spark, path, "npy", "entries", partition_bytes=999), two.shape) == two).all()
        else:
            assert got.count() == 0


def test_a_task_reads_its_own_range_only(tmp_path, monkeypatch):
    a = np.arange(200_000, dtype="f8").reshape(-1, 4)
    np.save(tmp_path / "a.npy", a)
    read = []
    real = A.opened

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            out = self.f.read(n)
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(A, "opened", lambda p: Counting(real(p)))
    parts = A.ArrayReader({"path": str(tmp_path / "a.npy"), "kind": "npy", "partitionBytes": "100000"}).partitions()
    assert len(parts) == 16 and sum(read) < 300
    read.clear()
    monkeypatch.setattr(A, "BATCH_BYTES", 10_000)
    got = list(A.lines(parts[3], False))
    assert sum(read) == (parts[3].end - parts[3].start) * 32 and max(read) <= 10_000
    assert (np.concatenate([b for _, b in got]) == a[parts[3].start : parts[3].end]).all()


@pytest.mark.parametrize("deflate", [False, True])
def test_sparse_npz(spark, tmp_path, monkeypatch, deflate):
    rng = np.random.default_rng(2)
    a = (rng.random((60, 80)) < 0.1) * rng.integers(0, 4, (60, 80))
    a[10:30] = 0
    save = np.savez_compressed if deflate else np.savez
    for kind, m in (("csr", a), ("csc", a.T)):
        _, ptr, idx, val = csc(m.T)
        path = f"{tmp_path}/{kind}.npz"
        save(path, indptr=np.array(ptr, "i4"), indices=np.array([*idx], "i4"), data=np.array([*val[:-1], 0.0]), format=kind.encode(), shape=np.array(a.shape))
        want = a.copy().astype(float)
        last = np.argwhere(m)[-1]
        want[tuple(last if kind == "csr" else last[::-1])] = 0
        got = A.read_array(spark, path, "npz", "entries", partition_bytes=500)
        assert got.rdd.getNumPartitions() == (1 if deflate else -(-len(idx) // 20))
        assert (filled(got, a.shape) == want).all()
        assert sorted(map(tuple, A.read_csr_edges(spark, path).collect())) == sorted(map(tuple, np.argwhere(want).tolist()))
        monkeypatch.setattr(A, "BATCH_BYTES", 24 * 7)
        parts = A.ArrayReader({"path": path, "kind": "npz", "layout": "entries", "partitionBytes": "1000"}).partitions()
        out = np.zeros(a.shape)
        for p in parts:
            for r, c, v in A.entries(p):
                np.add.at(out, (r, c), v)
        assert (out == want).all()


@pytest.mark.parametrize("deflate", [False, True])
def test_mat_graphs(spark, tmp_path, deflate):
    rng = np.random.default_rng(3)
    n, edges = 50, rng.integers(0, 50, (2, 200)).astype("f8")
    feats = (rng.random((n, 6)) < 0.3) * rng.normal(size=(n, 6))
    years = rng.integers(0, 9, (n, 1)).astype("i4")
    dense = rng.normal(size=(n, 6)).astype("f4")
    path = mat(tmp_path / "g.mat", matrix("num_nodes", np.array([[50.0]]), small=True, deflate=deflate), matrix("edge_index", edges, deflate=deflate), matrix("node_feat", sparse=csc(feats), deflate=deflate), matrix("x", dense, deflate=deflate), matrix("y", years, deflate=deflate), matrix("ab", np.array([[1, 2, 3]], "u1"), deflate=deflate))
    e, y, x = A.read_mat_graph(spark, path, "y")
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.T.astype(int).tolist()))
    assert sorted(map(tuple, y.collect())) == list(enumerate(years[:, 0].tolist()))
    assert (filled(x.withColumnRenamed("id", "row"), feats.shape) == feats).all()
    assert (filled(A.read_array(spark, path, "mat", "entries", "x", 500), dense.shape) == dense).all()
    assert (rows(A.read_array(spark, path, "mat", "columns", "x", 500)) == dense.T).all()
    assert rows(A.read_array(spark, path, "mat", "columns", "num_nodes")).tolist() == [[50.0]]
    assert rows(A.read_array(spark, path, "mat", "columns", "ab")).tolist() == [[1.0], [2.0], [3.0]]
    if deflate:
        with pytest.raises(Exception, match="order it is stored in"):
            A.read_array(spark, path, "mat", "rows", "x").count()
    else:
        assert (rows(A.read_array(spark, path, "mat", "rows", "x", 500)) == dense).all()
    with pytest.raises(Exception, match="no variable"):
        A.read_array(spark, path, "mat", "rows", "z").count()
