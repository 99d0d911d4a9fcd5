"""The forward pass and blocked powers against numpy."""

from math import erf

import numpy as np
import pytest

from plexus.operators import blocks, forward
from plexus.sources import splits


def table(spark, layers):
    rows = [(name, int(r), int(c), float(w[r, c])) for name, (w, _) in layers.items() for r, c in np.ndindex(*w.shape)]
    rows += [(name, int(r), -1, float(v)) for name, (_, b) in layers.items() for r, v in enumerate(b)]
    return spark.createDataFrame(rows, "layer string, row bigint, col bigint, value double")


def test_forward_pass(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n, hidden, heads = 25, 6, 2
    layer = lambda r, c: (rng.normal(size=(r, c)) / c**0.5, rng.normal(size=r) * 0.1)
    layers = {"in": layer(hidden, 5), "out": layer(3, hidden)} | {f"0.{p}": layer(hidden, hidden) for p in "qkvo"} | {"0.up": layer(9, hidden), "0.down": layer(hidden, 9)}
    x = rng.normal(size=(n, 5))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n - 1, (60, 2))})  # the last node has no edges
    put = lambda v, name: v @ layers[name][0].T + layers[name][1]
    norm = lambda v: (v - v.mean(1, keepdims=True)) / np.sqrt(v.var(1, keepdims=True) + 1e-5)
    h = put(x, "in")
    y = norm(h)
    q, k, v = (put(y, f"0.{p}").reshape(n, heads, -1) for p in "qkv")
    top, z = np.zeros_like(v), np.zeros((n, heads, 1))
    for s, d in pairs:
        w = np.exp(np.clip((k[s] * q[d]).sum(-1, keepdims=True) / np.sqrt(hidden // heads), -5, 5))
        top[d] += v[s] * w
        z[d] += w
    h = h + put((top / (z + 1e-6)).reshape(n, -1), "0.o")
    up = put(norm(h), "0.up")
    h = h + put(0.5 * up * (1 + np.vectorize(erf)(up / 2**0.5)), "0.down")
    out = put(norm(h), "out")
    want = out - np.log(np.exp(out).sum(1, keepdims=True))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>")
    weights = table(spark, layers)
    got = {r["id"]: r["logp"] for r in forward.forward(nodes, spark.createDataFrame(pairs, "src bigint, dst bigint"), weights, 1, heads).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(n))
    # A matrix that is too large to go to every task gives the same.
    monkeypatch.setattr(forward, "BLOCK", 2)
    big = {r["id"]: r["x"] for r in forward.dense(nodes, weights, "in", "relu", cells=1).collect()}
    assert all(big[i] == pytest.approx(np.maximum(put(x, "in"), 0)[i], abs=1e-12) for i in range(n))


def test_blocked_products_and_powers_of_groups(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(blocks, "PARTS", 2)
    n, size = 23, 4
    a = (rng.random((n, n)) < 0.2) * rng.random((n, n))
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    frame = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    groups = splits.random_groups(spark.range(n), 5, 3)
    splits.write_batches(groups, f"file://{tmp_path}", "s5")
    read = spark.read.parquet(f"file://{tmp_path}/data_s5.parquet")
    member = {(r["seq_id"], r["pos"]): r["node_id"] for r in read.collect()}
    assert sorted(member.values()) == list(range(n)) and {p for _, p in member} == set(range(5))
    got = blocks.grouped_powers(frame, read, 3, size).collect()
    powers = [np.linalg.matrix_power(a, m) for m in (1, 2, 3)]
    seen = {(member[r["seq_id"], r["row"]], member[r["seq_id"], r["col"]]): r["bias"] for r in got}
    group = {v: s for (s, _), v in member.items()}
    for i in range(n):
        for j in range(n):
            want = [p[i, j] for p in powers] if group[i] == group[j] else [0, 0, 0]
            assert seen.get((i, j), [0, 0, 0]) == pytest.approx(want, abs=1e-12)
            assert group[i] == group[j] or (i, j) not in seen
