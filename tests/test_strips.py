"""Work along edges by strips against brute force."""

import numpy as np
import pytest

from plexus.operators import spread, strips


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, v in {"STRIP_EDGES": 60, "SIDE": 16, "BAND": 4, "CHUNK": 7, "PACK": 5}.items():
        monkeypatch.setattr(strips, name, v)


def graph(spark, n=70, m=300, seed=1):
    rng = np.random.default_rng(seed)
    pairs = [(int(i), int(j)) for i, j in rng.integers(0, n - 2, (m, 2))]  # the last two nodes have no edges
    return pairs, spark.createDataFrame(pairs + pairs[:20], "src bigint, dst bigint"), rng


def test_sums_over_neighbours_of_a_multiset_of_strips(spark):
    pairs, edges, rng = graph(spark)
    x = rng.normal(size=(70, 3))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    of = strips.strips(edges.distinct(), len(pairs), 70)
    assert len(of.names) > 5
    got = {r["id"]: r["x"] for r in strips.summed(of, nodes, 3).collect()}
    assert got.keys() == {d for _, d in pairs}
    assert all(v == pytest.approx(sum(x[s] for s, d in set(pairs) if d == i)) for i, v in got.items())
    assert strips.summed(strips.strips(edges.where("src < 0"), 0, 0), nodes, 3).count() == 0


def test_propagation_writes_no_weight_of_an_edge(spark):
    pairs, edges, rng = graph(spark)
    x, a = rng.normal(size=(70, 3)), np.eye(70)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    w = a / np.sqrt(np.outer(a.sum(0), a.sum(0)))
    rows = {(r["id"], r["hop"]): r["x"] for r in spread.propagate_smoothed(edges, nodes, 2, 3).collect()}
    want = [x, w @ x, w @ w @ x]
    assert len(rows) == 210 and all(rows[i, h] == pytest.approx(want[h][i]) for i, h in rows)


def test_head_masses_by_strips(spark):
    from plexus.operators import attend, batches

    pairs, edges, rng = graph(spark)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(70, 3)))], "id bigint, x array<double>")
    want = dict(map(tuple, attend.head_mass(attend.weights(batches.grouped_heads(edges.distinct(), 4, 4), nodes, 3)).collect()))
    got = attend.grouped_head_mass(edges.distinct(), len(pairs), nodes, 3, 4)
    assert dict(map(tuple, got.collect())) == pytest.approx(want) and len(want) == 4
    assert attend.grouped_head_mass(edges.where("src < 0"), 0, nodes, 3, 4).count() == 0
