"""Columns that are sent to standing edges, and the Laplacian's vectors by them, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.operators import partition, spread, standing


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def graph(ids, pairs):
    place = {i: p for p, i in enumerate(ids)}
    a = np.eye(len(ids))
    for i, j in pairs:
        a[place[i], place[j]] = a[place[j], place[i]] = 1
    return a


@pytest.mark.parametrize("ids", [range(5, 75), [*range(0, 60), *range(1000, 1010)], range(20, 75)])
def test_sums_of_several_strips_and_blocks(spark, monkeypatch, ids):
    monkeypatch.setattr(standing, "STRIP_EDGES", 150)
    monkeypatch.setattr(standing, "SORTED", 60)
    monkeypatch.setattr(standing, "CELL", 9)
    monkeypatch.setattr(standing, "SIDE", 32)
    rng = np.random.default_rng(3)
    every = list(ids)
    ends = every if every[0] != 20 else [*range(5, 20), *every]  # ends that are no identifiers of the table
    pairs = [(ends[i], ends[j]) for i, j in rng.integers(0, len(ends), (250, 2))]
    of = standing.standing(arcs(spark, pairs + pairs[:30]), spark.createDataFrame([(i,) for i in every], "id bigint"))
    nodes = sorted({*every, *(i for p in pairs for i in p)})
    assert of.n == len(nodes) and len(of.names) > 2
    x = rng.random((2, of.n)).astype(np.float32)
    rows = [(p, bytearray(x[:, p * of.height : (p + 1) * of.height].tobytes())) for p in range(len(of.names))]
    sums = standing.with_sums(of, spark.createDataFrame(rows, "at int, v binary"), "v", lambda at, row, total: {"at": at, "s": total.ravel().tolist()}, "at int, s array<double>")
    got = np.concatenate([np.array(r["s"]).reshape(2, -1) for r in sums.orderBy("at").collect()], axis=1)
    a = graph(nodes, pairs) - np.eye(len(nodes))
    assert np.allclose(got, x.astype(float) @ a)
    of.drop()


def test_laplacian_makes_no_rows_of_weighted_edges(spark, monkeypatch):
    monkeypatch.setattr(spread, "sym_norm", lambda *_: pytest.fail("a row for each edge, dealt again every round"))
    monkeypatch.setattr(standing, "FEWEST", 8)
    rng = np.random.default_rng(4)
    ids = [7 * i for i in range(90)]
    pairs = [(7 * int(i), 7 * int(j)) for i, j in rng.integers(0, 88, (300, 2))]  # two nodes without edges: the eigenvalue 1 more than once
    out = {r["id"]: r["pe"] for r in spread.laplacian_encoding(arcs(spark, pairs), spark.range(90).select((F.col("id") * 7).alias("id")), 2).collect()}
    a = graph(ids, pairs)
    d = a.sum(0)
    m = a / np.sqrt(np.outer(d, d))
    x = np.linalg.qr(np.array([out[i] for i in ids]))[0]
    value = np.linalg.eigvalsh(m)[::-1][1:3]
    small = x.T @ m @ x
    assert np.allclose(np.linalg.eigvalsh(small)[::-1], value, atol=1e-9) and np.abs(m @ x - x @ small).max() < 1e-5
    assert np.abs(np.sqrt(d) @ x).max() < 1e-6


def test_few_nodes_have_fewer_vectors(spark):
    got = lambda pairs, n, k: {r["id"]: r["pe"] for r in spread.laplacian_encoding(arcs(spark, pairs), spark.range(n), k).collect()}
    assert got([(0, 1)], 1, 0) == {0: []} and got([], 1, 2) == {0: []} and got([], 0, 2) == {}
    two = got([(0, 1), (1, 0), (1, 1)], 2, 3)
    assert [len(v) for v in two.values()] == [1, 1] and two[0][0] == pytest.approx(-two[1][0])


def test_large_levels_are_refined_without_reading_their_edges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ids = [3 * i for i in range(120)]
    pairs = [(3 * int(i), 3 * int(j)) for i, j in rng.integers(0, 118, (500, 2)) if i // 30 == j // 30 or rng.random() < 0.1]
    nodes = spark.range(120).select((F.col("id") * 3).alias("id"))
    monkeypatch.setattr(partition, "FEWEST", 40)
    monkeypatch.setattr(partition, "PER_PART", 4)
    by_edges = {r["id"]: r["part"] for r in partition.balanced_parts(arcs(spark, pairs), nodes, 4).collect()}
    monkeypatch.setattr(partition, "LARGE", 1)
    monkeypatch.setattr(standing, "FEWEST", 16)
    monkeypatch.setattr(partition, "_pulls", lambda *_: pytest.fail("a pass over rows of edges"))
    assert {r["id"]: r["part"] for r in partition.balanced_parts(arcs(spark, pairs), nodes, 4).collect()} == by_edges
    assert sorted(by_edges) == ids
